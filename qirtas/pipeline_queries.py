"""Queries of the pipeline layer: verdicts, routing, rendering, documents, web, operations, limits; and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.tables import read
from qirtas.text_queries import BLOCKS_SQL, MARGIN_SQL
from qirtas.functions.protect import protect, restore
from qirtas.functions.text import host_allowed
from qirtas.operators import diagnostics, embedding, operations, rendering, vectors, verdicts, web
from qirtas.plans import pipeline
from qirtas.sources import jsonl, office
from qirtas.streaming import limits

_REPLY = "concat(case hit_id % 3 when 0 then '```json\n' else '' end, case when hit_id % 7 = 0 then 'not json' when hit_id % 11 = 0 then '[1]' else concat('{\"verdict\": \"', case when priority >= 8 then 'APPROVE' when priority = 1 then 'maybe' when priority = 2 then ' approve ' when priority = 3 then 'approve' else 'REVISE' end, '\", \"confidence\": ', case when hit_id % 5 = 0 then '\"high\"' else '0.5' end, '}') end, case hit_id % 3 when 0 then '\n```' else '' end)"


def verdict_parse(s: SparkSession, d: str) -> DataFrame:
    v = verdicts.parse_verdict(F.expr(_REPLY))
    return read(s, d, "glossary_hits").select("hit_id", v.alias("v")).select("hit_id", "v.verdict", F.size("v.violations").cast("bigint").alias("n_violations"), "v.confidence", F.length("v.critique").cast("bigint").alias("n_critique"))


def route_tm(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "context_chunks").select("chunk_id", verdicts.route_memory(1 - F.col("distance"), 0.7).alias("route"), F.round(1 - F.col("distance"), 6).alias("score"))


def route_audit(s: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("priority") >= 8, "APPROVE").otherwise("REVISE")
    return read(s, d, "glossary_hits").select("hit_id", verdicts.route_audit(v, F.coalesce("priority", F.lit(0)), 5).alias("route"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    h = read(s, d, "glossary_hits").where("source_term is not null and target_term is not null")
    one = F.array_sort(F.collect_set(F.struct("char_start", "source_term", "target_term", "law_ref")))
    return h.groupBy("doc_id").agg(one.alias("hits"))


def bindings_text(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d).select("doc_id", F.md5(rendering.bindings_text(F.col("hits"))).alias("text_md5"))


def query_augment(s: SparkSession, d: str) -> DataFrame:
    q = _hits(s, d).join(read(s, d, "documents").where("text is not null and lang in ('ar', 'en')"), "doc_id")
    direction = F.when(F.col("lang") == "en", "en-ar").otherwise("ar-en")
    return q.select("doc_id", F.md5(rendering.augmented_query(F.col("text"), direction, F.col("hits"))).alias("query_md5"))


def context_text(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "context_chunks").where("text is not null and law_slug is not null")
    per = c.groupBy("law_slug").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "law", "article", "text"))).alias("c"))
    return per.select("law_slug", F.md5(rendering.context_text(F.col("c"))).alias("text_md5"))


def batch_validate(s: SparkSession, d: str) -> DataFrame:
    raw = read(s, d, "raw_terms").select("raw_id", F.regexp_replace("line", '"source_term"', '"input"').alias("line"))
    return jsonl.valid_batch(jsonl.parse_lines(raw, jsonl.BATCH)).groupBy(F.length("input").cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


def _translator(prompts: pd.Series) -> pd.Series:
    return prompts.str.len().astype(str) + " characters drafted"


def _auditor(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: '{"verdict": "APPROVE", "confidence": 0.9}' if len(p) % 2 else '```json\n{"verdict": "REVISE", "critique": "again", "confidence": 0.4}\n```')


def _run(s: SparkSession, d: str, requests: DataFrame, entries: DataFrame) -> DataFrame:
    out = pipeline.run(requests.dropDuplicates(["request_id"]), read(s, d, "terms"), read(s, d, "context_chunks"), entries, _translator, _auditor, embedder=embedding.hash_embedder)
    return out.select("request_id", "route", "revision_count", F.size("glossary_hits").alias("n_hits"), F.size("context_chunks").alias("n_chunks"), "audit.verdict", F.size("history").alias("n_passes"), F.size("warnings").alias("n_warnings"), F.length(pipeline.batch_records(out)).alias("n_record"))


def pipeline_run(s: SparkSession, d: str) -> DataFrame:
    """Glossary hits as requests, every one through the whole pipeline with deterministic stand-ins for the models."""
    requests = read(s, d, "glossary_hits").where("source_term is not null and hit_id is not null").select(F.col("hit_id").alias("request_id"), F.col("source_term").alias("text"), F.lit(None).cast("string").alias("direction"))
    return _run(s, d, requests, read(s, d, "tm_entries").select("id", "source_sentence", "target_sentence", "source_lang"))


def pipeline_documents(s: SparkSession, d: str) -> DataFrame:
    """Whole documents as requests, against the whole translation memory."""
    requests = read(s, d, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("request_id"), "text", F.lit(None).cast("string").alias("direction"))
    return _run(s, d, requests, read(s, d, "tm_entries").select("id", "source_sentence", "target_sentence", "source_lang"))


def protect_restore(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "tm_entries").where("source_sentence is not null").select("id", "source_sentence", protect("source_sentence").alias("p"))
    back = restore("p.masked", "p.tokens")
    return p.select("id", F.md5(back).alias("text_md5"), (F.size(F.array_distinct("p.tokens")) == F.size("p.tokens")).alias("marked"))


def segment_dedup(s: SparkSession, d: str) -> DataFrame:
    lines = read(s, d, "documents").where("text is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    f = operations.first_seen(lines, ["source"], "line", ["doc_id", "pos"])
    return f.select("source", F.md5("line").alias("line_md5"), "doc_id", F.col("pos").cast("bigint").alias("pos"), "n_seen")


def page_paragraphs(s: SparkSession, d: str) -> DataFrame:
    pages = read(s, d, "context_chunks").select(F.col("law_slug").alias("doc"), F.col("chunk_idx").alias("page"), "text")
    text = office.sidecar_text(office.page_paragraphs(pages.where("doc is not null")))
    return text.select("doc", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "terms").where("source_term is not null")
    url = F.when(F.col("term_id") % 3 == 0, F.concat(F.lit("https://law.example.org/view."), (F.col("term_id") % 50).cast("string"))).otherwise(F.concat(F.lit("/doc/"), (F.col("term_id") % 40).cast("string")))
    link = F.concat(F.lit("<p><a class='x' href='"), url, F.lit("'><b>"), "source_term", F.lit("</b> &amp; more</a></p>"))
    t = t.withColumn("page_id", F.col("term_id") % 25).withColumn("link", link)
    return t.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("term_id", "link"))).getField("link"), "\n").alias("html")).withColumn("url", F.concat(F.lit("https://site"), F.col("page_id").cast("string"), F.lit(".example.org/search")))


def links_extract(s: SparkSession, d: str) -> DataFrame:
    return web.anchors(_pages(s, d)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "title")


def url_merge(s: SparkSession, d: str) -> DataFrame:
    return web.merge_urls(web.anchors(_pages(s, d))).select("page_id", "url", "title", F.md5("snippet").alias("snippet_md5"))


def results_topn(s: SparkSession, d: str) -> DataFrame:
    rows = web.first_by_url(web.anchors(_pages(s, d))).withColumn("source", F.col("page_id"))
    return web.top_per_source(rows, 5).select("page_id", "url", "title")


def host_allow(s: SparkSession, d: str) -> DataFrame:
    return web.anchors(_pages(s, d)).groupBy(host_allowed(F.col("url"), ["law.example.org", "site3.example.org"]).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def manifest_hash(s: SparkSession, d: str) -> DataFrame:
    files = read(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    return operations.manifest(files, ["model-a", "model-b"])


def ingest_summary(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "context_chunks")
    return c.agg(F.countDistinct("law_slug").alias("n_laws"), F.countDistinct("law_slug", "article", "lang").alias("n_articles"), F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("article").isNull()).alias("n_without_article"))


def document_report(s: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("target_sentence").isNull(), "failed").when(F.length("source_sentence") > 600, "skipped").otherwise("translated")
    return operations.report(read(s, d, "tm_entries").where("law_slug is not null").withColumn("outcome", o), "law_slug")


def dominant_direction(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "tm_entries").where("law_slug is not null and target_sentence is not null")
    return t.groupBy("law_slug").agg(F.count_if((F.col("source_lang") == "ar") & (F.col("target_lang") == "en")).alias("a"), F.count_if((F.col("source_lang") == "en") & (F.col("target_lang") == "ar")).alias("b")).select("law_slug", F.when(F.col("a") >= F.col("b"), "ar-en").otherwise("en-ar").alias("direction"))


def runlog_by_node(s: SparkSession, d: str) -> DataFrame:
    """Run-log aggregates over the events table: an extension."""
    e = read(s, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("node"), F.col("value").alias("latency_ms"))
    return e.groupBy("node", F.date_trunc("HOUR", "ts").cast("string").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.round(F.max("latency_ms"), 6).alias("max_ms"))


def _limited(s: SparkSession, d: str, rule) -> DataFrame:
    return limits.fold(read(s, d, "events"), rule, "user_id", "event_id")


def rate_limit_window(s: SparkSession, d: str) -> DataFrame:
    return _limited(s, d, limits.SlidingWindow(2, 3600.0))


def rate_limit_bucket(s: SparkSession, d: str) -> DataFrame:
    return _limited(s, d, limits.TokenBucket(1 / 3600.0, 2.0))


def ttl_cache_hits(s: SparkSession, d: str) -> DataFrame:
    return _limited(s, d, limits.CacheAge(7200.0))


def error_classes(s: SparkSession, d: str) -> DataFrame:
    """Errors made of hits: a status by id and a message that holds the note."""
    status = F.when(F.col("hit_id") % 4 == 0, 404).when(F.col("hit_id") % 4 == 1, 429).when(F.col("hit_id") % 4 == 2, 503)
    message = F.when(F.col("hit_id") % 3 == 0, "request timed out").when(F.col("hit_id") % 3 == 1, "connection refused").otherwise(F.coalesce("note", F.lit("")))
    return read(s, d, "glossary_hits").select("hit_id", diagnostics.engine_error(status, message).alias("engine"), diagnostics.cloud_error(status, message).alias("cloud"))


def offload_modes(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "context_chunks").select("chunk_id", diagnostics.offload_mode(F.col("char_end"), F.col("char_start")).alias("mode"))


def embedded_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Chunks embedded with the stand-in; every twentieth term asks for its three nearest chunks."""
    chunks = embedding.embed(read(s, d, "context_chunks").withColumn("vec_id", F.xxhash64("chunk_id")), "vec_id", "text", embedding.hash_embedder)
    asked = embedding.embed(read(s, d, "terms").where("term_id % 20 = 0").withColumnRenamed("term_id", "vec_id"), "vec_id", "source_term", embedding.hash_embedder)
    return vectors.nearest(asked, chunks, 3)


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    """Relational host capability, not the reference's."""
    l = read(s, d, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


def orders_by_nation(s: SparkSession, d: str) -> DataFrame:
    o, c, n = (read(s, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {q.__name__: q for q in (verdict_parse, route_tm, route_audit, bindings_text, query_augment, context_text, batch_validate, pipeline_run, pipeline_documents, protect_restore, segment_dedup, page_paragraphs, links_extract, url_merge, results_topn, host_allow, manifest_hash, ingest_summary, document_report, dominant_direction, runlog_by_node, rate_limit_window, rate_limit_bucket, ttl_cache_hits, error_classes, offload_modes, embedded_neighbours, pricing_summary, orders_by_nation)}

_SQL_REPLY = _REPLY.replace("'```json\n'", "'```json' || chr(10)").replace("'\n```'", "chr(10) || '```'")
_H = "(SELECT doc_id, list_sort(list(DISTINCT struct_pack(char_start := char_start, source_term := source_term, target_term := target_term, law_ref := law_ref)), 'ASC', 'NULLS FIRST') AS hits FROM glossary_hits WHERE source_term IS NOT NULL AND target_term IS NOT NULL GROUP BY 1)"
_PAGE = "(SELECT term_id % 25 AS page_id, 'https://site' || (term_id % 25) || '.example.org' AS host, row_number() OVER (PARTITION BY term_id % 25 ORDER BY term_id) - 1 AS pos, CASE WHEN term_id % 3 = 0 THEN 'https://law.example.org/view.' || (term_id % 50) ELSE 'https://site' || (term_id % 25) || '.example.org/doc/' || (term_id % 40) END AS url, trim(regexp_replace(' ' || source_term || '  & more', '\\s+', ' ', 'g')) AS title FROM terms WHERE source_term IS NOT NULL)".replace("\\\\", "\\")

def _folded(start: str, admitted: str, after: str) -> str:
    """SQL that folds each user's events in order of time; ``s`` is the state before, ``t`` the time in seconds."""
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS admitted, CAST({start} AS DOUBLE[]) AS s FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT user_id, i, event_id, admitted, {after} FROM (SELECT f.user_id, o.i, o.event_id, o.t, f.s, {admitted} AS admitted FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT event_id, admitted FROM f WHERE i > 0"""


_RECENT = "list_filter(s, lambda x: x > t - 3600)"
_TOKENS = "(CASE WHEN len(s) > 1 THEN least(CAST(2 AS DOUBLE), s[1] + CAST(1 AS DOUBLE) / 3600 * (t - s[2])) ELSE s[1] END)"
_BLOCKS = BLOCKS_SQL.format(t="text")
_PARAGRAPHS = f"(SELECT doc, t, min(struct_pack(page := page, pos := pos)) AS o FROM (SELECT law_slug AS doc, chunk_idx AS page, len(b) AS n, unnest(b) AS t, unnest(range(len(b))) AS pos FROM (SELECT law_slug, chunk_idx, {_BLOCKS} AS b FROM context_chunks WHERE text IS NOT NULL AND law_slug IS NOT NULL)) WHERE NOT ({MARGIN_SQL}) GROUP BY 1, 2)"

ORACLE = {
    "rate_limit_window": _folded("[]", f"len({_RECENT}) < 2", f"CASE WHEN admitted THEN {_RECENT} || [t] ELSE {_RECENT} END"),
    "rate_limit_bucket": _folded("[2]", f"{_TOKENS} >= 1", f"[{_TOKENS} - CAST(admitted AS INTEGER), t]"),
    "ttl_cache_hits": _folded("[]", "len(s) > 0 AND t - s[1] < 7200", "CASE WHEN admitted THEN s ELSE [t] END"),
    "page_paragraphs": f"SELECT doc, md5(text) AS text_md5, length(text) AS n FROM (SELECT doc, string_agg(t, chr(10) || chr(10) || '--- page break ---' || chr(10) || chr(10) ORDER BY page) AS text FROM (SELECT doc, o.page AS page, string_agg(t, chr(10) || chr(10) ORDER BY o.pos, t) AS t FROM {_PARAGRAPHS} GROUP BY 1, 2) GROUP BY 1)",
    "protect_restore": "SELECT id, md5(source_sentence) AS text_md5, true AS marked FROM tm_entries WHERE source_sentence IS NOT NULL",
    "verdict_parse": f"SELECT hit_id, CASE WHEN ok AND priority >= 8 THEN 'APPROVE' ELSE 'REVISE' END AS verdict, CAST(0 AS BIGINT) AS n_violations, CAST(CASE WHEN ok AND hit_id % 5 <> 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, CAST(CASE WHEN ok THEN 0 ELSE {len(verdicts.UNREADABLE)} END AS BIGINT) AS n_critique FROM (SELECT *, hit_id % 7 <> 0 AND hit_id % 11 <> 0 AS ok FROM glossary_hits)",
    "route_tm": "SELECT chunk_id, CASE WHEN 1 - distance >= 0.7::DOUBLE THEN 'bypass' ELSE 'translate' END AS route, round(1 - distance, 6) AS score FROM context_chunks",
    "route_audit": "SELECT hit_id, CASE WHEN priority >= 8 OR coalesce(priority, 0) >= 5 THEN 'finalize' ELSE 'translate' END AS route FROM glossary_hits",
    "bindings_text": f"SELECT doc_id, md5(array_to_string(list_transform(hits, lambda h: '- ' || h.source_term || ' = ' || h.target_term || CASE WHEN coalesce(h.law_ref, '') <> '' THEN ' (' || h.law_ref || ')' ELSE '' END), chr(10))) AS text_md5 FROM {_H}",
    "query_augment": f"SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text || chr(10) || array_to_string(list_transform(hits, lambda h: h.target_term), ' ') ELSE text END) AS query_md5 FROM {_H} JOIN documents USING (doc_id) WHERE text IS NOT NULL AND lang IN ('ar', 'en')",
    "context_text": "SELECT law_slug, md5(array_to_string(list_transform(c, lambda x, i: '[' || i || '] ' || coalesce(x.law, '') || ' art. ' || coalesce(x.article, '') || chr(10) || x.text), chr(10) || chr(10))) AS text_md5 FROM (SELECT law_slug, list(struct_pack(law := law, article := article, text := text) ORDER BY chunk_id, law, article, text) AS c FROM context_chunks WHERE text IS NOT NULL AND law_slug IS NOT NULL GROUP BY 1)",
    "batch_validate": "SELECT length(t) AS n_chars, count(*) AS n FROM (SELECT json_extract_string(line, '$.source_term') AS t FROM (SELECT CASE WHEN json_valid(line) THEN line END AS line FROM raw_terms) WHERE json_type(line) = 'OBJECT') WHERE length(t) <= 10000 AND trim(t) <> '' GROUP BY 1",
    "segment_dedup": "SELECT source, md5(line) AS line_md5, min(doc_id) AS doc_id, arg_min(pos, struct_pack(a := doc_id, b := pos)) AS pos, count(*) AS n_seen FROM (SELECT source, doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE line <> '' GROUP BY source, line",
    "links_extract": f"SELECT page_id, pos, url, title FROM {_PAGE}",
    "url_merge": f"SELECT page_id, url, t[1].title AS title, md5(array_to_string(list_transform(t[2:], lambda x: x.title), ' | ')) AS snippet_md5 FROM (SELECT page_id, url, list_sort(list(struct_pack(pos := pos, title := title))) AS t FROM (SELECT page_id, url, title, min(pos) AS pos FROM {_PAGE} GROUP BY ALL) GROUP BY 1, 2)",
    "results_topn": f"SELECT page_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) AS r FROM (SELECT page_id, url, arg_min(title, pos) AS title, min(pos) AS pos FROM {_PAGE} GROUP BY 1, 2)) WHERE r <= 5",
    "host_allow": f"SELECT split_part(url, '/', 3) IN ('law.example.org', 'site3.example.org') AS allowed, count(*) AS n FROM {_PAGE} GROUP BY 1",
    "manifest_hash": "SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, sha256(string_agg(path || '|' || h || '|' || size, chr(10) ORDER BY path, h, size) || chr(10) || 'model-a' || chr(10) || 'model-b') AS content_hash FROM (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h, strlen(text) AS size FROM documents WHERE text IS NOT NULL)",
    "ingest_summary": "SELECT count(DISTINCT law_slug) AS n_laws, count(DISTINCT CASE WHEN law_slug IS NOT NULL AND article IS NOT NULL AND lang IS NOT NULL THEN law_slug || '|' || article || '|' || lang END) AS n_articles, count(*) AS n_chunks, count(*) FILTER (WHERE article IS NULL) AS n_without_article FROM context_chunks",
    "document_report": "SELECT law_slug, count(*) AS n, count(*) FILTER (WHERE o = 'translated') AS translated, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed FROM (SELECT law_slug, CASE WHEN target_sentence IS NULL THEN 'failed' WHEN length(source_sentence) > 600 THEN 'skipped' ELSE 'translated' END AS o FROM tm_entries WHERE law_slug IS NOT NULL) GROUP BY 1",
    "dominant_direction": "SELECT law_slug, CASE WHEN count(*) FILTER (WHERE source_lang = 'ar' AND target_lang = 'en') >= count(*) FILTER (WHERE source_lang = 'en' AND target_lang = 'ar') THEN 'ar-en' ELSE 'en-ar' END AS direction FROM tm_entries WHERE law_slug IS NOT NULL AND target_sentence IS NOT NULL GROUP BY 1",
    "runlog_by_node": "SELECT event_type AS node, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms FROM events GROUP BY 1, 2",
    "error_classes": "SELECT hit_id, CASE WHEN hit_id % 4 = 0 THEN 'model_not_loaded' WHEN hit_id % 4 < 3 THEN 'connection' WHEN m LIKE '%timed out%' THEN 'timeout' WHEN regexp_matches(m, 'connect|refused|unreachable') THEN 'connection' ELSE 'other' END AS engine, CASE WHEN hit_id % 4 = 1 THEN 'quota' WHEN m LIKE '%timed out%' THEN 'timeout' WHEN hit_id % 4 = 2 OR m LIKE '%connection%' THEN 'connection' ELSE 'other' END AS cloud FROM (SELECT hit_id, CASE hit_id % 3 WHEN 0 THEN 'request timed out' WHEN 1 THEN 'connection refused' ELSE lower(coalesce(note, '')) END AS m FROM glossary_hits)",
    "offload_modes": "SELECT chunk_id, CASE WHEN coalesce(char_end, 0) <= 0 THEN 'not loaded' WHEN r >= 0.999 THEN '100% GPU' WHEN r <= 0.001 THEN 'CPU-only' ELSE printf('partial GPU (%.0f%% in VRAM)', r * 100) END AS mode FROM (SELECT chunk_id, char_end, CAST(coalesce(char_start, 0) AS DOUBLE) / char_end AS r FROM context_chunks)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2",
    "orders_by_nation": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
