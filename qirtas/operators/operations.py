"""Manifests, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, size, kind`` of files: glossary JSON or the rest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.col("path").rlike(r"\.json$|/glossary/"), "glossary").otherwise("corpus")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), kind.alias("kind"))


def manifest(files: DataFrame, models: list[str]) -> DataFrame:
    """One row: counts and a hash of the files in path order and the model names; equal inputs, equal hash."""
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256", "size")))
    lines = F.transform(listed, lambda f: F.concat_ws("|", f["path"], f["sha256"], f["size"].cast("string")))
    digest = F.sha2(F.concat_ws("\n", F.array_join(lines, "\n"), *[F.lit(m) for m in models]), 256)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), digest.alias("content_hash"))


def first_seen(segments: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Distinct texts with their first place in order, by partial aggregation rather than a window."""
    return segments.groupBy(*keys, text).agg(F.min(F.struct(*order)).alias("_o"), F.count(F.lit(1)).alias("n_seen")).select(*keys, text, *[F.col(f"_o.{o}").alias(o) for o in order], "n_seen")


def report(outcomes: DataFrame, key: str) -> DataFrame:
    """Per document: segments translated, skipped, failed."""
    return outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("translated", "skipped", "failed")])
