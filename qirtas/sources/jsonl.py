"""JSON lines of batch requests and parallel pairs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.plans.skew import numbered

BATCH = "input string, direction string"
PAIR = "source_sentence string, target_sentence string, source_lang string, target_lang string"
DIRECTIONS = ["ar-en", "en-ar", "auto"]
MOST_CHARS = 10_000


def parse_lines(lines: DataFrame, ddl: str, column: str = "line") -> DataFrame:
    """Fields of ``ddl`` and ``_corrupt``; blank lines are skipped."""
    r = F.from_json(F.col(column), ddl + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(F.trim(column) != "").withColumn("_r", r).select(*lines.columns, "_r.*")


def valid_batch(df: DataFrame) -> DataFrame:
    """Requests with a text of at most 10,000 characters and a known direction; others are left out."""
    return df.where(F.col("_corrupt").isNull() & (F.length("input") <= MOST_CHARS) & (F.trim("input") != "") & F.coalesce("direction", F.lit("auto")).isin(DIRECTIONS))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    return valid_batch(parse_lines(spark.read.text(path).withColumnRenamed("value", "line"), BATCH))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Parallel pairs; a malformed line is an error. Languages default to ar and en."""
    return _checked(parse_lines(spark.read.text(path).withColumnRenamed("value", "line"), PAIR))


def _checked(df: DataFrame) -> DataFrame:
    bad = F.col("_corrupt").isNotNull() | F.col("source_sentence").isNull() | F.col("target_sentence").isNull() | (F.length("source_sentence") > MOST_CHARS) | (F.length("target_sentence") > MOST_CHARS)
    checked = df.withColumn("source_sentence", F.when(bad, F.raise_error(F.concat(F.lit("malformed pair: "), F.left(F.col("line"), F.lit(80)))).cast("string")).otherwise(F.col("source_sentence")))
    return checked.select("source_sentence", "target_sentence", F.coalesce("source_lang", F.lit("ar")).alias("source_lang"), F.coalesce("target_lang", F.lit("en")).alias("target_lang"))


def read_pairs_strict(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The first ``most`` pairs by file and line, a cap that is the feature; a blank line is malformed too, and no pair at all is an error."""
    numbered_lines = numbered(spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), [], ["file", "block", "at"], "_n")
    few = numbered_lines.where(F.col("_n") < most)
    blank = F.raise_error(F.concat(F.lit("malformed pair: blank line "), F.col("_n").cast("string"))).cast("string")
    few = few.withColumn("line", F.when(F.trim("line") == "", blank).otherwise(F.col("line")))
    if few.isEmpty():
        raise ValueError(f"no pairs in {path}")
    return _checked(parse_lines(few.select("line"), PAIR))


def literal_or_file(spark: SparkSession, given: str, root: str) -> str:
    """The text of a file below ``root`` if ``given`` names one, else ``given`` itself; a file elsewhere is an error."""
    path = Path(given)
    try:
        found = path.is_file()
    except (OSError, ValueError):
        found = False
    if not found:
        return given
    if not path.resolve().is_relative_to(Path(root).resolve()):
        raise ValueError(f"{given} lies outside {root}")
    return path.read_text(encoding="utf-8")
