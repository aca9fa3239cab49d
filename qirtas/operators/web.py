"""Search result pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qirtas.functions.text import collapse_spaces

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'#]+)["'][^>]*>(.*?)</a>"""


def plain_html(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return collapse_spaces(text)


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, pos, url, title`` of a page's links; relative ones get the page's host. Pages without links give no row."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("body"))
    base = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("page_id"), F.concat_ws("://", F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))).alias("_host"), F.posexplode(both).alias("pos", "a"))
    absolute = F.when(F.col("a.href").rlike("^https?://"), F.col("a.href")).when(F.col("a.href").startswith("/"), F.concat("_host", "a.href")).otherwise(F.concat_ws("/", "_host", "a.href"))
    return base.select("page_id", "pos", absolute.alias("url"), plain_html(F.col("a.body")).alias("title"))


def merge_urls(rows: DataFrame) -> DataFrame:
    """One row per URL: its first title, other distinct titles joined as the snippet, in order."""
    first = rows.groupBy("page_id", "url", "title").agg(F.min("pos").alias("pos"))
    merged = first.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t"))
    return merged.select("page_id", "url", F.col("t")[0]["pos"].alias("pos"), F.col("t")[0]["title"].alias("title"), F.array_join(F.slice(F.col("t.title"), 2, 1_000_000), " | ").alias("snippet"))


def first_by_url(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id", "url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))


def linked_data(pages: DataFrame, query: str, key: str = "page_id", html: str = "html", most: int = 1 << 20) -> DataFrame:
    """Names and URLs of JSON-LD objects whose name holds the query; blocks above ``most`` characters are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    objects = pages.select(F.col(key).alias("page_id"), F.posexplode(blocks).alias("pos", "block")).where(F.length("block") <= most)
    one = F.when(F.trim("block").startswith("["), F.from_json("block", "array<struct<name: string, url: string, description: string>>")).otherwise(F.array(F.from_json("block", "struct<name: string, url: string, description: string>")))
    rows = objects.select("page_id", "pos", F.explode(one).alias("o"))
    return rows.where(F.contains(F.lower("o.name"), F.lower(F.lit(query)))).select("page_id", "pos", F.col("o.name").alias("title"), F.col("o.url").alias("url"), F.col("o.description").alias("snippet"))


def top_per_source(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` results of each source; the cap is the feature."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("pos", "url"))).where(F.col("_r") <= n).drop("_r")
