from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from qirtas.operators import corpus, diagnostics, embedding, glossary, operations
from qirtas.plans import documents, pipeline
from qirtas.sources import jsonl, sinks
from qirtas.streaming import limits


def test_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    assert sinks.collection_size(spark, path) == 0
    sinks.build_collection(spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int"), path)
    for _ in range(2):
        sinks.append_collection(spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "chunk_id string, v int"), path)
    assert sinks.collection_size(spark, path) == 3


def test_lines_and_pairs(spark, tmp_path):
    sinks.write_lines(spark.range(3), F.to_json(F.struct("id")), str(tmp_path / "o"), "id")
    lines = [x for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == [0, 1, 2]
    (tmp_path / "p.jsonl").write_text('{"source_sentence": "a", "target_sentence": "b"}\n\n')
    assert [tuple(r) for r in jsonl.read_pairs(spark, str(tmp_path / "p.jsonl")).collect()] == [("a", "b", "ar", "en")]
    (tmp_path / "q.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="malformed"):
        jsonl.read_pairs(spark, str(tmp_path / "q.jsonl")).collect()
    (tmp_path / "b.jsonl").write_text('{"input": "x", "direction": "ar-en"}\n{"input": "x", "direction": "fr-en"}\nbad\n' + json.dumps({"input": "y" * 10001, "direction": "ar-en"}))
    assert jsonl.read_batch(spark, str(tmp_path / "b.jsonl")).count() == 1


def test_corrections_and_log(spark, tmp_path):
    state = spark.createDataFrame([(1, "t", "ar-en", "d", "d"), (2, "u", "ar-en", "e", "e")], "request_id int, text string, direction string, draft string, final_output string")
    state = state.withColumn("audit", F.struct(F.lit("APPROVE").alias("verdict"), F.lit("").alias("critique"))).withColumn("revision_count", F.lit(0)).withColumn("glossary_hits", F.array(F.struct(F.lit("a").alias("source_term"))))
    edits = spark.createDataFrame([(1, " d "), (2, "better")], "request_id int, edited_draft string")
    out, pairs = pipeline.apply_edits(state, edits)
    sinks.append_corrections(out, str(tmp_path / "c"), "m")
    assert [(r.input_text, r.edited_draft) for r in spark.read.json(str(tmp_path / "c")).collect()] == [("u", "better")]
    assert sorted((r.source_sentence, r.target_sentence, r.source_lang) for r in pairs.collect()) == [("better", "u", "en"), ("u", "better", "ar")]
    sinks.write_run_log(out, str(tmp_path / "l"), "r", "translate")
    assert {r.glossary_hit_count for r in spark.read.json(str(tmp_path / "l")).collect()} == {1}


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "k int, t string")
    rows = embedding.embed(df, "k", "t", embedding.hash_embedder, batch=1).collect()
    assert [(r.k, len(r.embedding)) for r in rows] == [(1, 768), (4, 768)]
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(df, "k", "t", lambda x: [[1.0]] * len(x)).collect()


def test_manifest_and_models(spark):
    rows = [("a", "h1", 1), ("b", "h2", 2)]
    one, two, other = (operations.manifest(spark.createDataFrame(r, "path string, sha256 string, size bigint"), ["m"]).first() for r in (rows, rows[::-1], [("a", "h1", 1)]))
    assert one == two and one.content_hash != other.content_hash
    missing = spark.range(1).select(diagnostics.missing_models(F.array(F.lit("a"), F.lit("b:1")), F.array(F.lit("a:latest"))).alias("m")).first().m
    assert missing == ["b:1"]


def test_run_log_stream(spark, tmp_path):
    log = spark.sql("select timestamp_seconds(id * 100) as ts, 'n' as node, double(id) as latency_ms from range(10)")
    want = {(r.node, r.n) for r in limits.run_log(log).collect()}
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = limits.run_log(stream).writeStream.format("memory").queryName("log").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.node, r.n) for r in spark.table("log").collect()} == want


def test_swapped_sinks(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.build_collection(spark.range(3).selectExpr("string(id) as chunk_id"), path)
    failing = spark.range(2).selectExpr("string(id) as chunk_id", "if(id = 1, raise_error('no'), 1) as v")
    with pytest.raises(Exception, match="no"):
        sinks.build_collection(failing, path)
    assert sinks.collection_size(spark, path) == 3
    sinks.build_collection(spark.range(5).selectExpr("string(id) as chunk_id"), path)
    assert sinks.collection_size(spark, path) == 5
    sinks.write_manifest(operations.manifest(spark.createDataFrame([("a", "h", 1)], "path string, sha256 string, size bigint"), ["m"]), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().n_files == 1


def test_strict_pairs_and_literals(spark, tmp_path):
    good = '{"source_sentence": "a", "target_sentence": "b"}\n'
    (tmp_path / "p.jsonl").write_text(good * 3 + "\n")
    assert jsonl.read_pairs_strict(spark, str(tmp_path / "p.jsonl"), 3).count() == 3
    with pytest.raises(Exception, match="blank line"):
        jsonl.read_pairs_strict(spark, str(tmp_path / "p.jsonl"), 9).collect()
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        jsonl.read_pairs_strict(spark, str(tmp_path / "e.jsonl"), 9)
    assert jsonl.literal_or_file(spark, str(tmp_path / "p.jsonl"), str(tmp_path)).startswith("{")
    assert jsonl.literal_or_file(spark, "a text", str(tmp_path)) == "a text"
    with pytest.raises(ValueError):
        jsonl.literal_or_file(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "x"))


def test_glossary_files(spark, tmp_path):
    term = {"source_term": "عقد", "source_lang": "ar", "target_term": "contract", "target_lang": "en", "law_ref": "l"}
    head = {"domain": "d", "version": "1", "last_updated": "2020"}
    files = {"a": {**head, "terms": [term, {**term, "source_term": "بيع", "target_term": "sale"}]}, "b": {**head, "terms": [{**term, "target_lang": "xx"}]}, "c": {"domain": "d", "terms": [term]}, "d": {**head, "terms": []}, "e": [1], "f": {**head, "terms": [term, term]}}
    for name, x in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x, ensure_ascii=False))
    rows = spark.createDataFrame([(n, (tmp_path / f"{n}.json").read_text()) for n in files], "file_path string, content string")
    got = {r.file_path: r.problem for r in glossary.file_problems(rows).collect()}
    assert set(got) == set("bcdef") and got["c"].endswith("version, last_updated") and got["b"] == "term 0: unknown language" and got["f"].startswith("key twice")
    loaded = glossary.load_glossary(spark, [str(tmp_path / "a.json")])
    assert [(r.file_order, r.source_term_norm) for r in sorted(loaded.collect(), key=lambda r: r.file_order)] == [(0, "عقد"), (1, "بيع")]
    both = glossary.with_reverse(loaded)
    assert sorted((r.source_term, r.derived) for r in both.collect()) == [("contract", True), ("sale", True), ("بيع", False), ("عقد", False)]
    with pytest.raises(ValueError, match="unknown language"):
        glossary.load_glossary(spark, [str(tmp_path / f"{n}.json") for n in "ab"])


def test_corpus_files(spark, tmp_path):
    text = "LAW: Civil\nSOURCE: x\nLANG: en\n---\nARTICLE 1\n\n  body of it\nmore\nARTICLE 2\nlast"
    (tmp_path / "l_en.txt").write_text(text)
    rows = corpus.parse_corpus(corpus.read_corpus(spark, str(tmp_path / "l_en.txt"))).collect()
    assert len(rows) == 2 and all(text[r.char_start :].startswith(r.text) for r in rows)
    (tmp_path / "bad.txt").write_bytes(b"LAW: \xff")
    with pytest.raises(Exception, match="not UTF-8"):
        corpus.read_corpus(spark, str(tmp_path / "bad.txt")).collect()


def test_translated_files(spark):
    from tests.test_pipeline import document

    files = spark.createDataFrame([("a.docx", bytearray(document()))], "path string, content binary")
    out, told = documents.translate_files(files, lambda p: p.str.split("\n").str[1].str.upper())
    from qirtas.sources import office

    assert [s[2] for s in office.read_segments(bytes(out.first().content))] == ["HELLO WORLD"]
    assert told.first().translated == 1
    out, told = documents.translate_files(files, lambda p: p.map(lambda x: None), most_chars=3)
    assert told.first().skipped == 1 and [s[2] for s in office.read_segments(bytes(out.first().content))] == ["Hello world"]


def test_reaudit(spark):
    state = spark.createDataFrame([(1, "t", "ar-en", "d", "d"), (2, "u", "ar-en", "e", "e")], "request_id int, text string, direction string, draft string, final_output string")
    audit = F.struct(F.lit("APPROVE").alias("verdict"), F.lit("").alias("critique"), F.array().cast("array<string>").alias("violations"), F.lit(1.0).alias("confidence"))
    state = state.withColumn("audit", audit).withColumn("warnings", F.array().cast("array<string>"))
    out, _ = pipeline.apply_edits(state, spark.createDataFrame([(2, "better")], "request_id int, edited_draft string"))
    rows = {r.request_id: r for r in pipeline.reaudit(out, lambda p: p.map(lambda x: '{"verdict": "REVISE", "confidence": 0.2}')).collect()}
    assert rows[1].audit.verdict == "APPROVE" and not rows[1].warnings
    assert rows[2].audit.verdict == "REVISE" and rows[2].final_output == "better" and rows[2].warnings
