"""Queries of the knowledge layer: glossary, corpus, memory, vectors; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.tables import RAW_SQL, parse_records, read
from qirtas.operators import chunking, corpus, glossary, memory, vectors
from qirtas.plans.skew import numbered
from qirtas.text_queries import TRIGRAM_SQL, COLLAPSE


def glossary_conflict(s: SparkSession, d: str) -> DataFrame:
    return glossary.winners(read(s, d, "terms")).select("source_lang", "source_term_norm", "term_id", "target_term")


def glossary_reverse(s: SparkSession, d: str) -> DataFrame:
    return glossary.reverse_terms(read(s, d, "terms")).select("term_id", "source_lang", "target_lang", "source_term_norm")


def glossary_with_reverse(s: SparkSession, d: str) -> DataFrame:
    return glossary.with_reverse(read(s, d, "terms")).select("term_id", "source_lang", "target_lang", "source_term_norm", "derived")


def glossary_duplicates(s: SparkSession, d: str) -> DataFrame:
    return glossary.duplicate_keys(read(s, d, "terms"))


def glossary_validation(s: SparkSession, d: str) -> DataFrame:
    r = parse_records(read(s, d, "raw_terms"))
    return r.groupBy(F.coalesce(glossary.term_problem(r), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def glossary_scan(s: SparkSession, d: str) -> DataFrame:
    return glossary.scan(read(s, d, "documents"), read(s, d, "terms"), "doc_id", "text", "lang").select("doc_id", "lang", "char_start", "char_end", "term_id", "target_term")


def glossary_order(s: SparkSession, d: str) -> DataFrame:
    ordered = numbered(read(s, d, "terms").select("term_id", "file_path", "file_order"), [], ["file_path", "file_order", "term_id"], "_n")
    return ordered.select("term_id", (F.col("_n") + 1).alias("run"))


def hit_frequency(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "glossary_hits").groupBy("source_lang", "law_ref").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.max("priority").cast("bigint").alias("top"))


def article_parse(s: SparkSession, d: str) -> DataFrame:
    """Documents as corpus files: registers are written that way, others have a problem."""
    files = read(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return corpus.parse_corpus(files).select("path", "law", "source", "lang", "number", F.col("ordinal").cast("bigint").alias("ordinal"), F.md5("text").alias("text_md5"), "char_start", "problem")


def chunk_pack(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_articles(read(s, d, "documents"), ["doc_id"], "text").select("doc_id", "chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "char_start", "char_end")])


def chunk_leaves(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs, sentences and hard splits of all documents, by a small target so that each kind occurs."""
    own = chunking.leaf_units(read(s, d, "documents"), ["doc_id"], "text", 64)
    return own.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "char_start", "char_end")])


def corpus_align(s: SparkSession, d: str) -> DataFrame:
    """Arabic and English chunks of one place in one article."""
    c = read(s, d, "context_chunks").where("law_slug is not null and article is not null")
    a = c.select("law_slug", "lang", F.concat_ws("#", "article", "chunk_idx").alias("number"), "text")
    return corpus.align_articles(a).select("law_slug", "article", "source_lang", F.md5("source_sentence").alias("source_md5"), F.md5("target_sentence").alias("target_md5"))


def trigram_index(s: SparkSession, d: str) -> DataFrame:
    p = memory.postings(read(s, d, "tm_entries"))
    return p.groupBy("lang", "trigram").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first_id"))


def _queries(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "glossary_hits").where("hit_id % 20 = 0").select(F.col("hit_id").alias("query_id"), F.col("source_term").alias("text"), F.col("source_lang").alias("lang"))


def _terms(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "terms").select(F.col("term_id").alias("id"), F.col("source_term").alias("source_sentence"), F.col("target_term").alias("target_sentence"), "source_lang")


def tm_candidates(s: SparkSession, d: str) -> DataFrame:
    """Queries are every twentieth hit, against all terms."""
    return memory.candidates(_queries(s, d), _terms(s, d), 5).select("query_id", "entry_id", "shared", F.col("rank").cast("bigint").alias("rank"))


def tm_lookup(s: SparkSession, d: str) -> DataFrame:
    return memory.lookup(_queries(s, d), _terms(s, d), 0.6)


def _sentences(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "tm_entries").where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("source_sentence").alias("text"), F.col("source_lang").alias("lang"))


def tm_sentence_candidates(s: SparkSession, d: str) -> DataFrame:
    """Queries are every twentieth sentence, against the whole translation memory."""
    return memory.candidates(_sentences(s, d), read(s, d, "tm_entries"), 5).select("query_id", "entry_id", "shared", F.col("rank").cast("bigint").alias("rank"))


def tm_sentence_lookup(s: SparkSession, d: str) -> DataFrame:
    return memory.lookup(_sentences(s, d), read(s, d, "tm_entries"), 0.6)


def tm_exact(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "tm_entries").where("source_sentence is not null").select(F.col("id").alias("query_id"), F.col("source_sentence").alias("text"), F.col("source_lang").alias("lang"))
    return memory.exact_lookup(q, read(s, d, "tm_entries").where("target_sentence is not null")).select("query_id", "entry_id")


def tm_both_directions(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "tm_entries").where("source_sentence is not null and target_sentence is not null")
    return memory.both_directions(t).groupBy("source_lang", "target_lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("source_sentence")).alias("n_chars"))


def tm_rebuild(s: SparkSession, d: str) -> DataFrame:
    """A memory built anew from pairs."""
    return memory.rebuild(read(s, d, "tm_entries")).select("id", F.md5("source_sentence").alias("source_md5"), F.md5("target_sentence").alias("target_md5"), "article")


def tm_since(s: SparkSession, d: str) -> DataFrame:
    """The incremental range: ids of the upper half, in order of id."""
    t = read(s, d, "tm_entries")
    return t.where(F.col("id") >= (t.agg(F.max("id")).first()[0] or 0) // 2).select("id", "law_slug", "article", "source_lang", "target_lang").orderBy("id")


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings")
    n = vectors.nearest(v.where("vec_id % 20 = 0"), v, 8)
    return n.select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings")
    n = vectors.nearest(v.where("vec_id % 20 = 0"), v.where("label = 1"), 3)
    return n.select("query_id", "neighbour_id", F.round(1 - F.col("distance"), 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


QUERIES = {q.__name__: q for q in (glossary_conflict, glossary_reverse, glossary_with_reverse, tm_rebuild, glossary_duplicates, glossary_validation, glossary_scan, glossary_order, hit_frequency, article_parse, chunk_leaves, chunk_pack, corpus_align, trigram_index, tm_candidates, tm_lookup, tm_sentence_candidates, tm_sentence_lookup, tm_exact, tm_both_directions, tm_since, vector_topk, vector_topk_filtered)}

_N = COLLAPSE.format(c="lower(target_term)")
_NORM = rf"CASE target_lang WHEN 'ar' THEN translate(regexp_replace(target_term, '[\x{{064B}}-\x{{0652}}\x{{0640}}]', '', 'g'), 'أإآى', 'اااي') ELSE trim(regexp_replace({_N}, '[.,;:!?)\]}}\"'']+$', '')) END"
_TRI = TRIGRAM_SQL.format(t="t")
_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def _topk(where: str, k: int, value: str) -> str:
    return f"SELECT query_id, neighbour_id, {value}, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, {_COS} AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - {_COS}, 12), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {where}) WHERE rank <= {k}"


_TOKENS = "greatest(1, {a} // 2 + ({n} - {a}) // 4)"
_AR_COUNT = r"(length({t}) - length(regexp_replace({t}, '[\x{{0600}}-\x{{06FF}}]', '', 'g')))"


def _measured(t: str) -> str:
    return _TOKENS.format(a=_AR_COUNT.format(t=t), n=f"length({t})")


def _leaves_sql(target: int) -> str:
    """Common tables down to ``leaf`` (doc_id, k from 1, s, e, tok) for a target of tokens."""
    step = f"(CASE WHEN 2 * {_AR_COUNT.format(t='t')} > length(t) THEN {2 * target} ELSE {4 * target} END)"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE text <> ''),
cut AS (SELECT doc_id, string_split_regex(text, '\n\n+') AS p, list_transform(regexp_extract_all(text, '\n\n+'), lambda x: length(x)) || [0] AS gap FROM d),
placed AS (SELECT doc_id, unnest(p) AS t, unnest(list_transform(range(len(p)), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(gap[1:i]), 0))) AS s, unnest(range(len(p))) AS i FROM cut),
para AS (SELECT doc_id, i, CAST(CASE WHEN i = 0 AND t[1] = chr(10) THEN s + 1 ELSE s END AS BIGINT) AS s, CASE WHEN i = 0 AND t[1] = chr(10) THEN t[2:] ELSE t END AS t FROM placed WHERE t <> '' AND NOT (i = 0 AND t = chr(10))),
short AS (SELECT doc_id, s, t FROM para WHERE {_measured('t')} <= {target}),
piece AS (SELECT doc_id, s, unnest(w) AS t, unnest(list_transform(range(len(w)), lambda i: coalesce(list_sum(list_transform(w[1:i], lambda x: length(x))), 0))) AS o FROM (SELECT doc_id, s, regexp_extract_all(t, '[^.!?]*[.!?]+\s*|[^.!?]+$') AS w FROM para WHERE {_measured('t')} > {target})),
sent AS (SELECT doc_id, CAST(s + o AS BIGINT) AS s, t FROM piece WHERE t <> ''),
hard AS (SELECT doc_id, s + h AS s, least(s + h + w, s + length(t)) AS e FROM (SELECT doc_id, s, t, {step} AS w, unnest(range(0, length(t), {step})) AS h FROM sent WHERE {_measured('t')} > {target})),
span AS (SELECT doc_id, s, s + length(t) AS e FROM short UNION ALL SELECT doc_id, s, s + length(t) FROM sent WHERE {_measured('t')} <= {target} UNION ALL SELECT doc_id, s, e FROM hard),
leaf AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k, s, e, {_measured('substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))')} AS tok FROM span JOIN d USING (doc_id))"""


# Chunks grow from leaf to leaf over running sums: the state is the first leaf of a chunk and its first new one.
_PACK = _leaves_sql(512) + rf""", doc AS (SELECT doc_id, list(s ORDER BY k) AS s, list(e ORDER BY k) AS e, list(c ORDER BY k) AS c FROM (SELECT *, sum(tok) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM leaf) GROUP BY 1),
whole AS (SELECT doc_id, length(text) AS n, {_measured('text')} <= 512 AS fits FROM d),
grown AS (
  SELECT doc_id, 0 AS i, 1 AS a, 1 AS f, greatest(1, len(list_filter(c, lambda x: x <= 512))) AS b FROM doc JOIN whole USING (doc_id) WHERE NOT fits
  UNION ALL
  SELECT doc_id, i + 1, a2, f2, greatest(f2, len(list_filter(c, lambda x: x <= 512 + CASE WHEN a2 = 1 THEN 0 ELSE c[a2 - 1] END))) FROM (SELECT g.doc_id, i, b + 1 AS f2, greatest(a, 1 + len(list_filter([0] || c, lambda x: x < c[b] - 64))) AS a2, c FROM grown g JOIN doc USING (doc_id) WHERE b < len(c)))
SELECT doc_id, concat_ws('_', doc_id, i) AS chunk_id, CAST(i AS BIGINT) AS chunk_idx, CAST(s[a] AS BIGINT) AS char_start, CAST(e[b] AS BIGINT) AS char_end FROM grown JOIN doc USING (doc_id)
UNION ALL SELECT doc_id, concat_ws('_', doc_id, 0), 0, 0, n FROM whole WHERE fits"""

_HEAD = "max_by(trim(regexp_extract(line, '^{h}:(.*)$', 1)), pos) FILTER (WHERE starts_with(line, '{h}:') AND coalesce(pos < stop, true)) AS {n}"
_ARTICLES = rf"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(p) AS line, unnest(range(len(p))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
l2 AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY pos) - length(line) - 1 AS org FROM l),
m AS (SELECT *, min(CASE WHEN trim(line) = '---' THEN pos END) OVER (PARTITION BY path) AS stop, regexp_extract(line, '^ARTICLE\s+(.+?)\s*$', 1) AS n FROM l2),
h AS (SELECT path, max(stop) AS stop, {", ".join(_HEAD.format(h=x, n=x.lower()) for x in corpus.HEADER)} FROM m GROUP BY 1),
q AS (SELECT *, CASE WHEN stop IS NULL THEN 'no --- line' WHEN coalesce(law, '') = '' OR coalesce(source, '') = '' OR coalesce(lang, '') = '' THEN 'missing ' || concat_ws(', ', CASE WHEN coalesce(law, '') = '' THEN 'LAW' END, CASE WHEN coalesce(source, '') = '' THEN 'SOURCE' END, CASE WHEN coalesce(lang, '') = '' THEN 'LANG' END) WHEN lang NOT IN ('ar', 'en') THEN 'unknown language' END AS problem FROM h),
b AS (SELECT *, sum(CASE WHEN n <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS ordinal FROM m WHERE pos > stop),
a AS (SELECT path, CAST(ordinal AS BIGINT) AS ordinal, max(CASE WHEN n <> '' THEN lower(trim(regexp_replace(n, '\s+', ' ', 'g'))) END) AS number, min(org) FILTER (WHERE n = '') AS org, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n = ''), '') AS body FROM b WHERE ordinal > 0 GROUP BY 1, 2)
SELECT path, law, source, lang, number, ordinal, md5(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS text_md5, CAST(org + length(regexp_extract(body, '^\s*')) AS BIGINT) AS char_start, problem FROM q JOIN a USING (path) WHERE problem IS NULL
UNION ALL SELECT path, law, source, lang, NULL, NULL, NULL, NULL, problem FROM q WHERE problem IS NOT NULL"""

_LETTER = r"'[A-Za-z\x{0600}-\x{06FF}\x{0750}-\x{077F}]'"
_WINNERS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_lang, source_term_norm ORDER BY priority DESC NULLS LAST, length(source_term) DESC NULLS LAST, (coalesce(law_ref, '') <> '') DESC, file_order NULLS FIRST, term_id) AS r FROM terms WHERE source_term_norm IS NOT NULL) WHERE r = 1)"
# Every place where a term may begin meets the terms by up to three characters; then candidates are taken from left to right.
_SCAN = rf"""WITH RECURSIVE t AS (SELECT source_lang, source_term_norm AS norm, length(source_term_norm) AS n, substr(source_term_norm, 1, 3) AS key, term_id, target_term FROM {_WINNERS} WHERE source_lang IN ('ar', 'en') AND source_term_norm <> ''),
d AS (SELECT doc_id, lang, string_split(text, '') AS xc, string_split(CASE lang WHEN 'ar' THEN translate(regexp_replace(text, '[\x{{064B}}-\x{{0652}}\x{{0640}}]', '', 'g'), 'أإآى', 'اااي') ELSE lower(text) END, '') AS sc FROM documents WHERE lang IN ('ar', 'en') AND text <> ''),
m AS (SELECT doc_id, lang, xc, sc, CASE WHEN len(xc) <> len(sc) THEN list_filter(range(len(xc)), lambda i: NOT regexp_matches(xc[i + 1], '[\x{{064B}}-\x{{0652}}\x{{0640}}]')) || [len(xc)] ELSE range(len(xc) + 1) END AS org FROM d),
p AS (SELECT *, unnest(range(1, len(sc) + 1)) AS p FROM m),
b AS (SELECT *, unnest([sc[p], sc[p] || sc[p + 1], sc[p] || sc[p + 1] || sc[p + 2]]) AS key FROM p WHERE p = 1 OR CASE WHEN regexp_matches(sc[p], {_LETTER}) THEN org[p] - 1 = org[p - 1] AND (NOT regexp_matches(sc[p - 1], {_LETTER}) OR (lang = 'ar' AND sc[p - 1] IN ('ب', 'ف', 'ل', 'و'))) ELSE NOT regexp_matches(sc[p - 1], {_LETTER}) END),
c AS (SELECT doc_id, lang, org[p] AS s, org[p + n] AS e, n, term_id, target_term FROM b JOIN t ON b.lang = t.source_lang AND b.key = t.key WHERE p + n - 1 <= len(sc) AND array_to_string(sc[p:p + n - 1], '') = norm AND NOT regexp_matches(coalesce(xc[org[p + n] + 1], ' '), {_LETTER})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, n DESC) AS i FROM c),
k AS (SELECT *, true AS kept, e AS done FROM o WHERE i = 1 UNION ALL SELECT o.*, o.s >= k.done, CASE WHEN o.s >= k.done THEN o.e ELSE k.done END FROM k JOIN o ON o.doc_id = k.doc_id AND o.i = k.i + 1)
SELECT doc_id, lang, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, term_id, target_term FROM k WHERE kept"""

_REVERSE = f"WITH s AS (SELECT term_id, file_order, target_lang AS source_lang, source_lang AS target_lang, {_NORM} AS source_term_norm FROM terms WHERE target_lang IN ('ar', 'en') AND target_term IS NOT NULL) SELECT term_id, source_lang, target_lang, source_term_norm FROM (SELECT *, row_number() OVER (PARTITION BY source_term_norm, source_lang, target_lang ORDER BY file_order, term_id) AS r FROM s WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.source_term_norm = s.source_term_norm AND t.source_lang = s.source_lang AND t.target_lang = s.target_lang)) WHERE r = 1"

ORACLE = {
    "glossary_scan": _SCAN,
    "glossary_conflict": "SELECT source_lang, source_term_norm, term_id, target_term FROM (SELECT *, row_number() OVER (PARTITION BY source_lang, source_term_norm ORDER BY priority DESC NULLS LAST, length(source_term) DESC NULLS LAST, (coalesce(law_ref, '') <> '') DESC, file_order NULLS FIRST, term_id) AS r FROM terms WHERE source_term_norm IS NOT NULL) WHERE r = 1",
    "glossary_reverse": _REVERSE,
    "glossary_with_reverse": f"SELECT term_id, source_lang, target_lang, source_term_norm, false AS derived FROM terms UNION ALL SELECT term_id, source_lang, target_lang, source_term_norm, true FROM ({_REVERSE})",
    "tm_rebuild": "SELECT row_number() OVER (ORDER BY source_sentence NULLS FIRST, target_sentence NULLS FIRST, source_lang NULLS FIRST, target_lang NULLS FIRST, law_slug NULLS FIRST, article NULLS FIRST) AS id, md5(source_sentence) AS source_md5, md5(target_sentence) AS target_md5, article FROM tm_entries WHERE source_sentence IS NOT NULL AND target_sentence IS NOT NULL",
    "glossary_duplicates": "SELECT file_path, source_term_norm, source_lang, target_lang, count(*) AS n FROM terms GROUP BY ALL HAVING count(*) > 1",
    "glossary_order": "SELECT term_id, row_number() OVER (ORDER BY file_path, file_order, term_id) AS run FROM terms",
    "hit_frequency": "SELECT source_lang, law_ref, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(max(priority) AS BIGINT) AS top FROM glossary_hits GROUP BY 1, 2",
    "article_parse": _ARTICLES,
    "chunk_leaves": _leaves_sql(64) + " SELECT doc_id, k - 1 AS pos, s AS char_start, e AS char_end FROM leaf",
    "chunk_pack": _PACK,
    "glossary_validation": f"SELECT coalesce(CASE WHEN trim(coalesce(source_term, '')) = '' OR trim(coalesce(target_term, '')) = '' THEN 'blank term' WHEN NOT coalesce(source_lang IN ('ar', 'en') AND target_lang IN ('ar', 'en'), false) THEN 'unknown language' WHEN source_lang = target_lang THEN 'same language' WHEN law_ref IS NULL THEN 'missing law_ref' END, 'ok') AS outcome, count(*) AS n FROM {RAW_SQL} GROUP BY 1",
    "corpus_align": "WITH a AS (SELECT law_slug, lang, concat_ws('#', article, chunk_idx) AS number, text FROM context_chunks WHERE law_slug IS NOT NULL AND article IS NOT NULL AND text <> '') SELECT x.law_slug, x.number AS article, x.lang AS source_lang, md5(x.text) AS source_md5, md5(y.text) AS target_md5 FROM a x JOIN a y ON x.law_slug = y.law_slug AND x.number = y.number AND ((x.lang = 'ar' AND y.lang = 'en') OR (x.lang = 'en' AND y.lang = 'ar'))",
    "trigram_index": f"SELECT lang, trigram, count(*) AS n, min(id) AS first_id FROM (SELECT id, lang, unnest({_TRI}) AS trigram FROM (SELECT id, source_lang AS lang, lower({COLLAPSE.format(c='source_sentence')}) AS t FROM tm_entries WHERE source_sentence IS NOT NULL)) GROUP BY 1, 2",
    "tm_candidates": f"WITH q AS (SELECT hit_id AS query_id, source_lang AS lang, unnest({_TRI}) AS g FROM (SELECT *, lower({COLLAPSE.format(c='source_term')}) AS t FROM glossary_hits WHERE hit_id % 20 = 0 AND source_term IS NOT NULL)), e AS (SELECT term_id AS entry_id, source_lang AS lang, unnest({_TRI}) AS g FROM (SELECT *, lower({COLLAPSE.format(c='source_term')}) AS t FROM terms WHERE source_term IS NOT NULL)), c AS (SELECT query_id, entry_id, count(*) AS shared FROM q JOIN e USING (lang, g) GROUP BY 1, 2) SELECT query_id, entry_id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, entry_id) AS rank FROM c) WHERE rank <= 5",
    "tm_exact": "SELECT q.id AS query_id, min(e.id) AS entry_id FROM tm_entries q JOIN tm_entries e ON q.source_sentence = e.source_sentence AND q.source_lang = e.source_lang WHERE e.target_sentence IS NOT NULL GROUP BY 1",
    "tm_both_directions": "SELECT source_lang, target_lang, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT source_lang, target_lang, source_sentence AS s FROM tm_entries WHERE source_sentence IS NOT NULL AND target_sentence IS NOT NULL UNION ALL SELECT target_lang, source_lang, target_sentence FROM tm_entries WHERE source_sentence IS NOT NULL AND target_sentence IS NOT NULL) GROUP BY 1, 2",
    "tm_since": "SELECT id, law_slug, article, source_lang, target_lang FROM tm_entries WHERE id >= (SELECT max(id) // 2 FROM tm_entries)",
    "vector_topk": _topk("true", 8, "round(1 - c, 6) AS distance"),
    "vector_topk_filtered": _topk("v.label = 1", 3, "round(c, 6) AS score"),
}
