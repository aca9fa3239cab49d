"""Test tables, and the glossary records among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ["source_term", "source_lang", "target_term", "target_lang", "law_ref", "article_ref", "note", "priority"]
RECORD_DDL = "source_term string, source_lang string, target_term string, target_lang string, law_ref string, article_ref string, note string, priority int"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parse_records(raw: DataFrame) -> DataFrame:
    """Glossary records of JSON lines; a line that holds no JSON object is no record."""
    trimmed = F.trim(F.regexp_replace("line", r"\s+", " "))
    whole = trimmed.startswith("{") & trimmed.endswith("}")
    ddl = RECORD_DDL + ", _broken string"
    parsed = raw.withColumn("_r", F.from_json("line", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return parsed.where(whole & F.col("_r").isNotNull() & F.col("_r._broken").isNull()).select("raw_id", *[F.col(f"_r.{c}").alias(c) for c in RECORD])


#: The same records in SQL.
RAW_SQL = "(SELECT raw_id, " + ", ".join(f"json_extract_string(line, '$.{c}') AS {c}" if c != "priority" else "CAST(json_extract_string(line, '$.priority') AS INTEGER) AS priority" for c in RECORD) + " FROM (SELECT raw_id, CASE WHEN json_valid(line) THEN line END AS line FROM raw_terms) WHERE line IS NOT NULL AND json_type(line) = 'OBJECT')"
