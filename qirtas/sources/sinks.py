"""Sinks: JSON lines, vector collections, run logs, corrections, manifests. Replacing ones are written beside the old and swapped in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, record: Column, path: str, order: str | None = None) -> None:
    """One JSON line per row, in order if one is named."""
    ordered = df.orderBy(order) if order else df
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    ordered.select(record.alias("value")).write.text(new)
    _swap(df.sparkSession, new, path)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put ``new`` in the place of ``path`` by renaming; the old one goes only when the new one stands."""
    jvm = spark._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{new}-old"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = system.exists(target)
    if had and not system.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not system.rename(fresh, target):
        if had:
            system.rename(old, target)
        raise OSError(f"cannot put {path} in place")
    if had:
        system.delete(old, True)


def build_collection(chunks: DataFrame, path: str) -> None:
    """A collection built beside the old one and swapped in when complete; a failure leaves the old one."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    chunks.write.parquet(new)
    _swap(chunks.sparkSession, new, path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest's one row as JSON, swapped in when complete."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    manifest.coalesce(1).write.json(new)
    _swap(manifest.sparkSession, new, path)


def append_collection(chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Adds chunks whose key the collection doesn't hold yet."""
    known = chunks.sparkSession.read.parquet(path).select(key)
    chunks.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)


def collection_size(spark: SparkSession, path: str) -> int:
    """Rows of a collection; 0 if it can't be opened."""
    try:
        return spark.read.parquet(path).count()
    except Exception:
        return 0


def write_run_log(state: DataFrame, path: str, run_id: str, node: str) -> None:
    """A record per request: lengths and counts, missing ones as 0."""
    size = lambda c: F.greatest(F.size(c), F.lit(0)) if c in state.columns else F.lit(0)
    length = lambda c: F.coalesce(F.length(c), F.lit(0)) if c in state.columns else F.lit(0)
    state.select(F.current_timestamp().alias("ts"), F.lit(run_id).alias("run_id"), F.lit(node).alias("node"), length("text").alias("input_length"), size("glossary_hits").alias("glossary_hit_count"), size("context_chunks").alias("chunk_count"), length("draft").alias("draft_length")).write.mode("append").json(path)


def append_corrections(state: DataFrame, path: str, model: str) -> None:
    """Human edits only: the state's rows with ``edited`` set, with draft, edit and verdict."""
    state.where("edited").select(F.current_timestamp().alias("timestamp"), F.col("text").alias("input_text"), "direction", F.col("draft").alias("original_draft"), F.col("final_output").alias("edited_draft"), F.coalesce("audit.verdict", F.lit("N/A")).alias("audit_verdict"), F.coalesce("audit.critique", F.lit("")).alias("audit_critique"), "revision_count", "glossary_hits", F.lit(model).alias("model")).write.mode("append").json(path)
