from __future__ import annotations

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from qirtas.operators import verdicts, web
from qirtas.plans import pipeline
from qirtas.sources import office
from qirtas.streaming import limits
from tests.test_knowledge import ROWS, terms


def test_verdicts(spark):
    cases = {'```json\n{"verdict": "APPROVE", "confidence": "0.5", "violations": ["a"]}\n```': ("APPROVE", 0.5, 1), "junk": ("REVISE", 0.0, 0), "[1]": ("REVISE", 0.0, 0), '{"critique": "c"}': ("REVISE", 0.0, 0), '{"verdict": "APPROVE", "violations": "x", "confidence": "high"}': ("APPROVE", 0.0, 0), None: ("REVISE", 0.0, 0), '{"verdict": " approve ", "confidence": 0.5}': ("REVISE", 0.5, 0), '{"verdict": "approve"}': ("REVISE", 0.0, 0), '```python\n{"verdict": "APPROVE"}\n```': ("REVISE", 0.0, 0), '{"verdict": ["APPROVE"]}': ("REVISE", 0.0, 0)}
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", verdicts.parse_verdict(F.col("r")).alias("v"))
    assert {r.r: (r.v.verdict, r.v.confidence, len(r.v.violations)) for r in df.collect()} == cases
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([('{"verdict": "APPROVE", "confidence": 2}',)], "r string").select(verdicts.parse_verdict(F.col("r"))).collect()


def revise(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: '{"verdict": "REVISE", "critique": "no", "confidence": 0.1}')


def draft(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: " draft 2 " if "Previous draft" in p else "draft 1")


def test_pipeline(spark):
    requests = spark.createDataFrame([(1, " the contract of sale ", None), (2, "contract of sale", "en-ar"), (3, "nothing known", None)], "request_id bigint, text string, direction string")
    chunks = spark.createDataFrame([("c1", "a contract of sale is made", "Civil", "1", "en")], "chunk_id string, text string, law string, article string, lang string")
    entries = spark.createDataFrame([(1, "contract of sale", "عقد البيع", "en")], "id bigint, source_sentence string, target_sentence string, source_lang string")
    rows = {r.request_id: r for r in pipeline.run(requests, terms(spark, ROWS), chunks, entries, draft, revise, max_revisions=1).collect()}
    assert rows[2].route == "bypass" and rows[2].final_output == "عقد البيع" and rows[2].audit.verdict == "APPROVE"
    assert rows[1].revision_count == 1 and rows[1].final_output == "draft 2" and len(rows[1].history) == 2 and "revision cap reached" in rows[1].warnings
    assert len(rows[1].context_chunks) == 1 and "no context found" in rows[3].warnings and rows[1].glossary_hits[0].char_start == 4


def document() -> bytes:
    w = office.WORD[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:p/></w:body></w:document>')
        z.writestr("word/media/x.bin", b"\x00\x01")
    return out.getvalue()


def test_office(spark):
    files = spark.createDataFrame([("a.docx", bytearray(document()))], "path string, content binary")
    seg = office.segments(files).collect()
    assert [(s.part, s.text) for s in seg] == [("word/document.xml", "Hello world")]
    t = spark.createDataFrame([("a.docx", "Hello world", "مرحبا")], "path string, text string, translation string")
    new = bytes(office.patched(files, t).first().content)
    assert [s[2] for s in office.read_segments(new)] == ["مرحبا"] and b"bidi" in zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml")
    assert zipfile.ZipFile(io.BytesIO(new)).read("word/media/x.bin") == b"\x00\x01"


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "Header\n\nA real paragraph here.\n\n12\n\nAnother one again.\n\nfoot"), ("d", 2, "A real\n paragraph here.\n\nLast words stand."), ("d", 3, None)], "doc string, page int, text string")
    assert office.sidecar_text(office.page_paragraphs(pages)).first().text == "A real paragraph here.\n\nAnother one again.\n\n--- page break ---\n\nLast words stand."


def test_web(spark):
    html = "<a href='/x'>One <b>two</b></a><a href='https://h/y'>Y</a><a href='/x'>More</a><script type='application/ld+json'>{\"name\": \"Civil law\", \"url\": \"u\"}</script>"
    pages = spark.createDataFrame([(1, "https://s/q", html), (2, "https://s/q", None)], "page_id bigint, url string, html string")
    rows = sorted((r.url, r.title, r.snippet) for r in web.merge_urls(web.anchors(pages)).collect())
    assert rows == [("https://h/y", "Y", ""), ("https://s/x", "One two", "More")]
    assert [r.title for r in web.linked_data(pages, "CIVIL").collect()] == ["Civil law"]


def test_limits(spark):
    rows = [(i, "u", t) for i, t in enumerate([0, 10, 20, 61, 62, 300])]
    df = spark.createDataFrame(rows, "event_id int, user_id string, s int").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts")
    got = lambda rule: [r.admitted for r in sorted(limits.fold(df, rule, "user_id", "event_id").collect())]
    assert got(limits.SlidingWindow(2, 60)) == [True, True, False, True, False, True]
    assert got(limits.TokenBucket(1 / 60, 1)) == [True, False, False, True, False, True]
    assert got(limits.CacheAge(60)) == [False, True, True, False, True, False]


def test_limits_as_stream(spark, tmp_path):
    rows = [(i, "u", t) for i, t in enumerate([0, 10, 20, 61])]
    spark.createDataFrame(rows, "event_id int, user_id string, s int").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, user_id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = limits.fold_stream(stream, limits.SlidingWindow(2, 60), "user_id", "event_id").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.admitted for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, True]
