"""Queries of the text scalars, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.sources import office
from qirtas.tables import read
from qirtas.functions import text as T
from qirtas.functions.protect import protect

AR = "[؀-ۿ]"


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("lang in ('ar', 'en') and text is not null").select("doc_id", F.md5(T.normalize(F.col("text"), F.col("lang"))).alias("norm_md5"), F.length(T.normalize(F.col("text"), F.col("lang"))).cast("bigint").alias("n"))


def script_direction(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", T.detect_direction(F.col("text")).alias("direction"), T.is_arabic_dominant(F.col("text")).alias("arabic"))


def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text is not null").select("doc_id", T.approx_token_count(F.col("text")).cast("bigint").alias("n_tokens"))


def script_guard(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "tm_entries").where("target_sentence is not null and source_lang is not null and target_lang is not null")
    direction = F.concat_ws("-", "source_lang", "target_lang")
    return t.where(direction.isin("ar-en", "en-ar")).select("id", T.script_warning(F.col("target_sentence"), direction).alias("warned"))


def article_numbers(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "tm_entries").where("article is not null").groupBy(T.article_number(F.col("article")).alias("article")).agg(F.count(F.lit(1)).alias("n"))


def sentence_units(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "context_chunks").where("text is not null").select("chunk_id", F.posexplode(T.sentence_pieces(F.col("text"))).alias("pos", "piece"))
    return p.select("chunk_id", F.col("pos").cast("bigint").alias("pos"), F.length("piece").cast("bigint").alias("n"), F.md5("piece").alias("piece_md5"))


def protect_tokens(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "tm_entries").where("source_sentence is not null").select("id", F.md5(T.mask_protected(F.col("source_sentence"))).alias("masked_md5"), F.md5(F.regexp_replace(protect("source_sentence")["masked"], "\\x00T[0-9]+\\x00", "⟦⟧")).alias("numbered_md5"))


def xml_escaped(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text is not null").select("doc_id", F.length(T.xml_escape(F.col("text"))).cast("bigint").alias("n"))


def zip_entries(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "terms").select("term_id", T.safe_zip_entry(F.concat_ws("/", "file_path", "law_ref")).alias("safe"))


def page_numbers(s: SparkSession, d: str) -> DataFrame:
    b = read(s, d, "context_chunks").where("text is not null").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))
    return b.groupBy("chunk_id").agg(F.count_if(T.is_page_number(F.col("block"))).alias("n_page_numbers"), F.count(F.lit(1)).alias("n_blocks"))


def page_margins(s: SparkSession, d: str) -> DataFrame:
    """Blocks of every chunk taken for a page, and those of them that are headers or footers."""
    pages = read(s, d, "context_chunks").select("chunk_id", F.lit(0).alias("page"), "text")
    b = office.page_blocks(pages, "chunk_id")
    return b.groupBy(F.col("doc").alias("chunk_id")).agg(F.count_if(office.is_margin(F.col("pos"), F.col("n"), F.col("text"))).alias("n_margins"), F.count(F.lit(1)).alias("n_blocks"))


def query_validation(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "glossary_hits")
    ok = (F.trim("source_term") != "") & (F.length("source_term") <= 500)
    return t.where("source_term is not null").select("hit_id", ok.alias("valid"), F.least(F.greatest(F.coalesce("priority", F.lit(0)), F.lit(1)), F.lit(100)).cast("bigint").alias("n"))


def model_names(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "terms").select("term_id", T.model_name(F.coalesce("law_ref", F.lit(""))).alias("name"), T.redact(F.col("source_term"), "of").alias("redacted"))


def trigram_sets(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "terms").where("source_term is not null").select("term_id", F.size(T.trigrams(F.col("source_term"))).cast("bigint").alias("n"))


QUERIES = {q.__name__: q for q in (normalize_text, script_direction, token_estimate, script_guard, article_numbers, sentence_units, protect_tokens, xml_escaped, zip_entries, page_numbers, page_margins, query_validation, model_names, trigram_sets)}

COLLAPSE = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_AR_NORM = r"translate(regexp_replace(text, '[\x{064B}-\x{0652}\x{0640}]', '', 'g'), 'أإآى', 'اااي')"
_EN_NORM = "trim(regexp_replace(" + COLLAPSE.format(c="lower(text)") + r""", '[.,;:!?)\]}"'']+$', ''))"""
_COUNT = "(length({c}) - length(regexp_replace({c}, '{k}', '', 'g')))"


# What is protected, in SQL's own expressions: one that looks neither behind nor ahead takes the neighbour and is applied twice.
_W = r"\p{L}\p{N}_"
_NUMBER = rf"(^|[^{_W}/])-?\p{{Nd}}+(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}+)?($|[^{_W}/])"
_SIMPLE = [r"https?://[^\s<>\"'']+", rf"[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+", r"\$\{[^}]+\}", r"\{[^}]+\}", rf"<[A-Za-z_][{_W}.-]*>", rf"%[A-Za-z_][{_W}]*%", r"&[A-Za-z0-9\"&]"]


def _masked(c: str) -> str:
    for p in _SIMPLE:
        c = f"regexp_replace({c}, '{p}', '⟦⟧', 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '{_NUMBER}', '\1⟦⟧\2', 'g')"
    return c


BLOCKS_SQL = r"list_filter(list_transform(string_split_regex({t}, '\n\s*\n'), lambda x: trim(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[ \t\r\f]*\n\s*', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9\s,.\-]+$'))"
MARGIN_SQL = r"n > 2 AND (pos = 0 OR pos = n - 1) AND length(t) < 60 AND NOT (len(string_split_regex(t, '\s+')) >= 2 AND len(list_filter(string_split_regex(t, '\s+'), lambda x: regexp_matches(x, '^\p{L}{4,}$'))) > 0)"
TRIGRAM_SQL = r"(CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) < 3 THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) + 1), lambda i: substr(' ' || {t} || ' ', i, 3))) END)"
_T = "lower(" + COLLAPSE.format(c="source_term") + ")"

ORACLE = {
    "normalize_text": f"SELECT doc_id, md5(v) AS norm_md5, length(v) AS n FROM (SELECT doc_id, CASE lang WHEN 'ar' THEN {_AR_NORM} ELSE {_EN_NORM} END AS v FROM documents WHERE lang IN ('ar', 'en') AND text IS NOT NULL)",
    "script_direction": f"SELECT doc_id, CASE WHEN a >= l THEN 'ar-en' ELSE 'en-ar' END AS direction, a >= l AS arabic FROM (SELECT doc_id, {_COUNT.format(c='t', k=AR)} AS a, {_COUNT.format(c='t', k='[A-Za-z]')} AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "token_estimate": f"SELECT doc_id, greatest(1, a // 2 + (n - a) // 4) AS n_tokens FROM (SELECT doc_id, length(text) AS n, {_COUNT.format(c='text', k=AR)} AS a FROM documents WHERE text IS NOT NULL)",
    "script_guard": f"SELECT id, CASE WHEN n = 0 THEN false WHEN source_lang = 'ar' THEN a / n > 0.2 ELSE l / n > 0.8 AND a = 0 END AS warned FROM (SELECT id, source_lang, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '{AR}'))) AS a, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '{AR}'))) AS l FROM (SELECT id, source_lang, list_filter(string_split({COLLAPSE.format(c='target_sentence')}, ' '), lambda x: x <> '') AS w FROM tm_entries WHERE target_sentence IS NOT NULL AND source_lang || '-' || target_lang IN ('ar-en', 'en-ar')))",
    "article_numbers": f"SELECT lower({COLLAPSE.format(c='article')}) AS article, count(*) AS n FROM tm_entries WHERE article IS NOT NULL GROUP BY 1",
    "sentence_units": r"SELECT chunk_id, pos, length(piece) AS n, md5(piece) AS piece_md5 FROM (SELECT chunk_id, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM (SELECT chunk_id, regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$') AS p FROM context_chunks WHERE text IS NOT NULL))",
    "protect_tokens": f"SELECT id, md5(v) AS masked_md5, md5(v) AS numbered_md5 FROM (SELECT id, {_masked('source_sentence')} AS v FROM tm_entries WHERE source_sentence IS NOT NULL)",
    "xml_escaped": "SELECT doc_id, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n FROM documents WHERE text IS NOT NULL",
    "zip_entries": r"SELECT term_id, v <> '' AND NOT starts_with(v, '/') AND NOT contains(v, '\') AND NOT list_contains(string_split(v, '/'), '..') AS safe FROM (SELECT term_id, concat_ws('/', file_path, law_ref) AS v FROM terms)",
    "page_numbers": r"SELECT chunk_id, count(*) FILTER (WHERE regexp_matches(block, '^[0-9\s,.\-]+$')) AS n_page_numbers, count(*) AS n_blocks FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS block FROM context_chunks WHERE text IS NOT NULL) GROUP BY 1",
    "page_margins": f"SELECT chunk_id, count(*) FILTER (WHERE {MARGIN_SQL}) AS n_margins, count(*) AS n_blocks FROM (SELECT chunk_id, len(b) AS n, unnest(b) AS t, unnest(range(len(b))) AS pos FROM (SELECT chunk_id, {BLOCKS_SQL.format(t='text')} AS b FROM context_chunks WHERE text IS NOT NULL)) GROUP BY 1",
    "query_validation": "SELECT hit_id, trim(source_term) <> '' AND length(source_term) <= 500 AS valid, CAST(least(greatest(coalesce(priority, 0), 1), 100) AS BIGINT) AS n FROM glossary_hits WHERE source_term IS NOT NULL",
    "model_names": "SELECT term_id, CASE WHEN contains(coalesce(law_ref, ''), ':') THEN law_ref ELSE coalesce(law_ref, '') || ':latest' END AS name, replace(source_term, 'of', '***') AS redacted FROM terms",
    "trigram_sets": f"SELECT term_id, len({TRIGRAM_SQL.format(t=_T)}) AS n FROM terms WHERE source_term IS NOT NULL",
}
