"""Corpus files of laws, and the alignment of their articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qirtas.functions.text import article_number

HEADER = ("LAW", "SOURCE", "LANG")


def slug_and_language(path: Column) -> tuple[Column, Column]:
    """From a file name such as ``civil_code_ar.txt``."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.regexp_replace(name, r"[_-](ar|en)$", ""), F.regexp_extract(name, r"_(ar|en)$", 1)


def parse_corpus(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Articles of whole texts: ``path, law, source, lang, number, text, ordinal, char_start, problem``.

    A header of LAW, SOURCE and LANG lines (the last of each counts) ends at the
    line '---'; 'ARTICLE n' lines open articles, whose lines are joined again. A
    body's ``char_start`` counts from the file's first character. A
    file without a complete header or with an unknown language gives one row with
    its ``problem``. Ordered by line within a file only: files are independent.
    """
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line"))
    by_file = Window.partitionBy("path")
    lines = lines.withColumn("_at", F.sum(F.length("line") + 1).over(by_file.orderBy("pos")) - F.length("line") - 1)
    marked = lines.withColumn("_end", F.min(F.when(F.trim("line") == "---", F.col("pos"))).over(by_file))
    named = [F.max_by(F.trim(F.regexp_extract("line", f"^{h}:(.*)$", 1)), F.when(F.col("line").startswith(f"{h}:") & (F.coalesce(F.col("pos") < F.col("_end"), F.lit(True))), F.col("pos"))).alias(h.lower()) for h in HEADER]
    heads = marked.groupBy("path").agg(F.max("_end").alias("_end"), *named)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(h.lower()), F.lit("")) == "", h) for h in HEADER]))
    heads = heads.withColumn("problem", F.when(F.col("_end").isNull(), "no --- line").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(~F.col("lang").isin("ar", "en"), "unknown language"))
    number = F.regexp_extract("line", r"^ARTICLE\s+(.+?)\s*$", 1)
    body = marked.where("pos > _end").withColumn("_open", F.when(number != "", 1).otherwise(0)).withColumn("ordinal", F.sum("_open").over(by_file.orderBy("pos")))
    articles = body.where("ordinal > 0").groupBy("path", "ordinal").agg(F.max(F.when(F.col("_open") == 1, article_number(number))).alias("number"), F.array_sort(F.collect_list(F.when(F.col("_open") == 0, F.struct("pos", "line")))).alias("_l"), F.min(F.when(F.col("_open") == 0, F.col("_at"))).alias("_at"))
    articles = articles.withColumn("_body", F.array_join(F.col("_l.line"), "\n")).withColumn("text", F.regexp_replace("_body", r"^\s+|\s+$", ""))
    articles = articles.withColumn("char_start", (F.col("_at") + F.length(F.regexp_extract("_body", r"^\s*", 0))).cast("bigint")).drop("_l", "_at", "_body")
    good = heads.where("problem is null").drop("_end").join(articles, "path")
    return good.unionByName(heads.where("problem is not null").drop("_end"), allowMissingColumns=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of text files as strict UTF-8: a file that is none is an error. Articles of one file lie in one row, as the format is read by lines."""
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    broken = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")
    return files.select("path", F.when(F.is_valid_utf8(text), text).otherwise(broken).alias("content"))


def last_articles(articles: DataFrame) -> DataFrame:
    """One body per (slug, language, number): the last of repeated numbers."""
    return articles.groupBy("law_slug", "lang", "number").agg(F.max_by("text", "ordinal").alias("text"))


def align_articles(articles: DataFrame) -> DataFrame:
    """Both directions of articles that exist in Arabic and English under one (law_slug, number), both bodies non-empty."""
    full = articles.where("text <> ''")
    ar, en = (full.where(F.col("lang") == g).select("law_slug", "number", F.col("text").alias(g)) for g in ("ar", "en"))
    pairs = ar.join(en, ["law_slug", "number"])
    forth = pairs.select("law_slug", F.col("number").alias("article"), F.col("ar").alias("source_sentence"), F.col("en").alias("target_sentence"), F.lit("ar").alias("source_lang"), F.lit("en").alias("target_lang"))
    back = pairs.select("law_slug", F.col("number").alias("article"), F.col("en").alias("source_sentence"), F.col("ar").alias("target_sentence"), F.lit("en").alias("source_lang"), F.lit("ar").alias("target_lang"))
    return forth.unionByName(back)


def first_per_file(articles: DataFrame, limit: int) -> DataFrame:
    return articles.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))).where(F.col("_r") <= limit).drop("_r")
