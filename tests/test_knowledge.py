from __future__ import annotations

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from qirtas.operators import corpus, glossary, memory, vectors
from tests.conftest import DATA

TERM = "term_id bigint, source_term string, source_lang string, target_term string, target_lang string, law_ref string, article_ref string, note string, priority int, source_term_norm string, file_order int, file_path string"


def terms(spark, rows):
    full = [(i, s, g, t, "en" if g == "ar" else "ar", "law", None, None, p, s.lower().translate(str.maketrans("أإآى", "اااي")), i, "f") for i, (s, g, t, p) in enumerate(rows)]
    return spark.createDataFrame(full, TERM)


ROWS = [("عقد البيع", "ar", "contract of sale", 10), ("عقد", "ar", "contract", 5), ("المحكمة", "ar", "court", 10), ("المحكمة الاتحادية", "ar", "Federal Supreme Court", 10), ("contract of sale", "en", "عقد البيع", 10), ("عقد", "ar", "agreement", 7)]


@pytest.mark.parametrize(
    ("text", "lang", "wanted"),
    [
        ("العقدة كبيرة", "ar", []),
        ("See the contract of sale here.", "en", [(8, 24, "عقد البيع")]),
        ("المحكمة الاتحادية قررت", "ar", [(0, 17, "Federal Supreme Court")]),
        ("وقع عقد هنا", "ar", [(4, 7, "agreement")]),
        ("بعقد البيع", "ar", [(1, 10, "contract of sale")]),
        ("عقد،", "ar", []),
        ("عَقْدٌ جديد", "ar", [(0, 6, "agreement")]),
        ("", "en", []),
        (None, "en", []),
        ("contract of sale", "xx", []),
    ],
)
def test_scan(spark, text, lang, wanted):
    docs = spark.createDataFrame([(1, text, lang)], "doc_id bigint, text string, lang string")
    got = sorted((r.char_start, r.char_end, r.target_term) for r in glossary.scan(docs, terms(spark, ROWS), "doc_id", "text", "lang").collect())
    assert got == wanted


@pytest.mark.parametrize("way", ["automaton", "pattern", "join"])
def test_scan_against_regex(spark, monkeypatch, way):
    if way == "pattern":
        monkeypatch.setattr(glossary, "finder", glossary.pattern_finder)
    if way == "join":
        monkeypatch.setattr(glossary, "DICTIONARY_TERMS", 0)
    docs = spark.read.parquet(str(DATA / "documents.parquet")).where("lang = 'en' and text is not null")
    own = spark.read.parquet(str(DATA / "terms.parquet"))
    got = {(r.doc_id, r.char_start, r.char_end, r.term_id) for r in glossary.scan(docs, own, "doc_id", "text", "lang").collect()}
    best = {r.source_term_norm: r.term_id for r in glossary.winners(own).where("source_lang = 'en'").collect()}
    alternatives = "|".join(re.escape(t) for t in sorted(best, key=len, reverse=True))
    edge = "A-Za-z؀-ۿݐ-ݿ"
    pattern = re.compile(f"(?<![{edge}])(?:{alternatives})(?![{edge}])")
    want = {(r.doc_id, m.start(), m.end(), best[m[0]]) for r in docs.collect() for m in pattern.finditer(r.text.lower())}
    assert got == want and want


def test_finders():
    terms_ = ["a", "ab", "abab", "babc", "b c", "عقد"]
    text = "ababab b c abc عقد"
    want = sorted((i, t) for t in terms_ for i in range(len(text)) if text.startswith(t, i))
    assert sorted(glossary.automaton_finder(terms_)(text)) == want == sorted(glossary.pattern_finder(terms_)(text))


@pytest.mark.parametrize("rows", [ROWS, [*ROWS, ("د", "ar", "d", 1)]])
def test_scan_ways_agree(spark, monkeypatch, rows):
    texts = ["بعقد البيع والعقد عقد", "عَقْدٌ عــقد المحكمة الاتحادية", "لعقد وعقد فعقد كعقد", "a contract of sale contract of sales", "د بد لد"]
    docs = spark.createDataFrame([(i, t, g) for i, t in enumerate(texts) for g in ("ar", "en")], "doc_id int, text string, lang string")
    got = []
    for most in (10, 0):
        monkeypatch.setattr(glossary, "DICTIONARY_TERMS", most)
        got.append(sorted(tuple(r) for r in glossary.scan(docs, terms(spark, rows), "doc_id", "text", "lang").select("doc_id", "lang", "char_start", "char_end", "target_term").collect()))
    assert got[0] == got[1] and got[0]


def test_reverse_terms(spark):
    got = {(r.source_term, r.target_term) for r in glossary.reverse_terms(terms(spark, ROWS)).collect()}
    assert ("court", "المحكمة") in got and ("contract of sale", "عقد البيع") not in got


def test_corpus(spark):
    body = "LAW: Civil\nSOURCE: x\nLANG: en\n---\nARTICLE 1\nfirst line\nsecond\n\nARTICLE 148  Bis\nbody\n"
    files = spark.createDataFrame([("c_en.txt", body), ("bad.txt", "LAW: x\n---\n"), ("none.txt", "LAW: x")], "path string, content string")
    rows = corpus.parse_corpus(files).collect()
    assert [(r.number, r.text) for r in sorted((r for r in rows if r.problem is None), key=lambda r: r.ordinal)] == [("1", "first line\nsecond"), ("148 bis", "body")]
    assert {r.path: r.problem for r in rows if r.problem} == {"bad.txt": "missing SOURCE, LANG", "none.txt": "no --- line"}
    articles = spark.createDataFrame([("l", "ar", "1", "ا", 1), ("l", "en", "1", "a", 1), ("l", "en", "2", "b", 1), ("l", "ar", "2", "", 1)], "law_slug string, lang string, number string, text string, ordinal int")
    assert corpus.align_articles(articles).count() == 2


def test_memory(spark):
    entries = spark.createDataFrame([(1, "the court shall decide", "x", "en"), (2, "the court shall not decide", "y", "en"), (3, "elsewhere", "z", "en")], "id bigint, source_sentence string, target_sentence string, source_lang string")
    q = spark.createDataFrame([(1, "the court shall decide", "en"), (2, "the court shall now decide", "en"), (3, "qqq", "en"), (4, None, "en"), (5, "", "en")], "query_id bigint, text string, lang string")
    got = {r.query_id: (r.entry_id, round(r.similarity, 6)) for r in memory.lookup(q, entries, 0.5).collect()}
    assert got == {1: (1, 1.0), 2: (2, round(difflib.SequenceMatcher(None, "the court shall now decide", "the court shall not decide").ratio(), 6))}
    again = memory.append_pairs(spark.createDataFrame([("elsewhere", "z", "en", "ar"), ("new", "n", "en", "ar")], "source_sentence string, target_sentence string, source_lang string, target_lang string"), entries.withColumn("target_lang", F.lit("ar")))
    assert [(r.source_sentence, r.id > 3) for r in again.collect()] == [("new", True)]


def test_memory_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcde fgh"), size=rng.integers(1, 60))) for _ in range(60)]
    texts = base + [t[:k] + "x" + t[k + 1 :] for t in base for k in (0, len(t) // 2)] + [t + "y" for t in base] + base[:5] + ["", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaab"]
    entries = spark.createDataFrame([(i, t, "t", "en" if i % 7 else "ar") for i, t in enumerate(texts)], "id bigint, source_sentence string, target_sentence string, source_lang string")
    q = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*base, *(t[1:] for t in base), "aaaaaaaaaaaaaaaaaaaaaaac"])], "query_id bigint, text string, lang string")
    for threshold in (0.98, 0.93):
        got = {r.query_id: round(r.similarity, 9) for r in memory.lookup(q, entries, threshold).collect()}
        want = {}
        for r in q.collect():
            top = max(difflib.SequenceMatcher(None, r.text, t).ratio() for i, t in enumerate(texts) if i % 7)
            if top >= threshold:
                want[r.query_id] = round(top, 9)
        assert got == want and len(want) > 30
    built = memory.rebuild(entries.withColumn("target_lang", F.lit("fr")).withColumn("law_slug", F.lit(None).cast("string")).withColumn("article", F.lit("1")))
    assert sorted(r.id for r in built.collect()) == list(range(1, len(texts) + 1))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.neighbour_id) for r in vectors.nearest(df.where("vec_id < 5"), df, 4).collect())
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = [(q, k + 1, int(j)) for q in range(5) for k, j in enumerate(np.argsort(1 - u[q] @ u.T, kind="stable")[:4])]
    assert got == want
    assert vectors.nearest(df.limit(0), df, 3).count() == 0


def test_lookup_in_the_whole_memory(spark):
    from __spark_entry__ import queries

    d = str(DATA)
    entries = spark.read.parquet(f"{d}/tm_entries.parquet").where("source_sentence is not null and source_lang is not null")
    asked = {r.id: r.source_sentence for r in entries.where("id % 20 = 0").collect()}
    found = {r.query_id: r for r in queries()["tm_sentence_lookup"](spark, d).collect()}
    assert asked and all(found[k].similarity == 1.0 and found[k].source_sentence == t for k, t in asked.items() if len(t) > 2)
    ranks = queries()["tm_sentence_candidates"](spark, d).where("rank = 1").count()
    assert ranks == len([t for t in asked.values() if t.strip()])


def test_lookup_without_shared_trigrams(spark):
    e = spark.createDataFrame([(1, "abc", "x", "en"), (2, "abc", "y", "fr"), (3, "zzzzzz", "z", "en")], "id bigint, source_sentence string, target_sentence string, source_lang string")
    q = spark.createDataFrame([(1, "ab", "en"), (2, "qq", "en"), (3, None, "en"), (4, "", "en")], "query_id bigint, text string, lang string")
    assert [(r.query_id, r.entry_id, r.similarity) for r in memory.lookup(q, e, 0.6).collect()] == [(1, 1, 0.8)]


def test_vectors_stay_off_the_driver(spark, monkeypatch):
    """Blocks of queries meet blocks of rows: the same neighbours as by brute force, equal vectors, zeros and NaN included."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 11)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6)).astype(np.float32)
    v[40:50] = v[3]
    v[50], v[51, 2] = 0, np.nan
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (None, v[0].tolist())], "vec_id bigint, embedding array<float>").repartition(3)

    def refuse(*_):
        raise AssertionError("vectors must not go through the driver")

    monkeypatch.setattr(type(df), "toPandas", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in vectors.nearest(df.where("vec_id < 30"), df, 4).collect()}
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-30)
    d = np.round(1 - (u[:30, None, :] * u[None]).sum(2), 12)
    assert got == {(q, r + 1): int(i) for q in range(30) for r, i in enumerate(np.lexsort((np.arange(60), d[q]))[:4])}


def test_shared_trigrams_by_blocks(spark, monkeypatch):
    """Blocks of entries and queries give what counting all shared trigrams gives, short texts, ties and other languages included, without a posting shuffled."""
    from qirtas.operators import grams

    monkeypatch.setattr(grams, "ENTRIES", 9)
    monkeypatch.setattr(grams, "QUERIES", 4)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd عقد😀"), n)) for n in rng.integers(0, 40, 80)] + ["a", "ab", "", " A  b ", None]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else "ar", "x") for i, t in enumerate(texts)], "id bigint, source_sentence string, source_lang string, target_sentence string").repartition(3)

    def refuse(*_):
        raise AssertionError("postings must not be shuffled")

    monkeypatch.setattr(memory, "postings", refuse)
    asked = df.select(F.col("id").alias("query_id"), F.col("source_sentence").alias("text"), F.col("source_lang").alias("lang"))
    got = sorted((r.query_id, r["rank"], r.entry_id, r.shared) for r in memory.candidates(asked, df, 3).collect())
    own = {}
    for i, t in enumerate(texts):
        t = re.sub(r"\s+", " ", t or "").strip().lower()
        own[i] = {t} - {""} if len(t) < 3 else {f" {t} "[j : j + 3] for j in range(len(t))}
    want = []
    for q in own:
        best = sorted((-len(own[q] & own[e]), e) for e in own if (e % 3 == 0) == (q % 3 == 0) and own[q] & own[e])[:3]
        want += [(q, r + 1, e, -n) for r, (n, e) in enumerate(best)]
    assert got == want
