"""Queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.llm import abuse, bitext, lookalikes, packing, sentences
from qirtas.llm import leaks as leak_ops
from qirtas.llm.format_duplicates import collapse_format_duplicates, format_duplicate_groups
from qirtas.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from qirtas.llm.split_oversized import rechunk
from qirtas.tables import RECORD, parse_records, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chunks, entries = read(spark, d, "context_chunks"), read(spark, d, "tm_entries")
    model = sentences.train(sentences.sample_texts(chunks, "chunk_id", "text") + sentences.sample_texts(entries, "id", "source_sentence"))
    parts = [sentences.sentences(df, key, text, model).select(F.lit(t).alias("in_table"), "row_key", "char_start", "char_end") for t, df, key, text in (("context_chunks", chunks, "chunk_id", "text"), ("tm_entries", entries, "id", "source_sentence"))]
    return reduce(DataFrame.unionByName, parts)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The glossary records of all three tables under ``in_table`` and ``id``."""
    parts = (("civil_code", read(spark, d, "civil_code"), "record_id"), ("un_international", read(spark, d, "un_international"), "record_id"), ("raw_terms", parse_records(read(spark, d, "raw_terms")), "raw_id"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("in_table"), F.col(key).alias("id"), *RECORD) for t, df, key in parts])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicate_groups(_records(spark, d), "id", RECORD, ["in_table"]).where("member_id <> first_id").select("in_table", "first_id", F.col("member_id").alias("copy_id"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per group with the number of its copies."""
    return collapse_format_duplicates(_records(spark, d), "id", RECORD, ["in_table"]).select("in_table", F.col("id").alias("first_id"), *RECORD, "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(read(spark, d, "tm_entries"), "id", "source_sentence", "target_sentence", expand_limit=None)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per translation memory row with its class of equal texts and the number of links to other classes."""
    members, links = near_duplicate_classes(read(spark, d, "tm_entries"), "id", "source_sentence", "target_sentence")
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.col("n_rows").alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rechunk(read(spark, d, "context_chunks")).where("was_split").select(F.col("source_chunk_id").alias("chunk_id")).distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All chunks within the limit: pieces of the oversized ones and the others, renumbered."""
    return rechunk(read(spark, d, "context_chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    terms, hits = read(spark, d, "terms"), read(spark, d, "glossary_hits")
    parts = [
        lookalikes.look_pairs(terms, "term_id", "source_term_norm").select(F.lit("terms").alias("in_table"), "row_key", "twin_key"),
        lookalikes.look_pairs(read(spark, d, "tm_entries"), "id", "source_sentence").select(F.lit("tm_entries").alias("in_table"), "row_key", "twin_key"),
        lookalikes.look_matches(hits, "hit_id", "source_term", terms, "term_id", "source_term").select(F.lit("glossary_hits").alias("in_table"), "row_key", "twin_key"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every term and sentence that looks like another of different characters, with its class and how many rows share its very characters."""
    inputs = (("terms", "term_id", "source_term_norm"), ("tm_entries", "id", "source_sentence"))
    return reduce(DataFrame.unionByName, [lookalikes.look_classes(read(spark, d, t), key, text).select(F.lit(t).alias("in_table"), "row_key", "class_key", F.col("n_rows").alias("n_copies")) for t, key, text in inputs])


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    """One consistent form of every term, hit and sentence."""
    inputs = (("terms", "term_id", "source_term_norm"), ("tm_entries", "id", "source_sentence"), ("glossary_hits", "hit_id", "source_term"))
    return reduce(DataFrame.unionByName, [lookalikes.unify(read(spark, d, t), key, text).select(F.lit(t).alias("in_table"), "row_key", "canonical") for t, key, text in inputs])


def _leaks(spark: SparkSession, d: str, least_run: int) -> DataFrame:
    return leak_ops.leaks(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text", least_run)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose alignment is worth 15 words, of which those that hold an unbroken run of so many."""
    return _leaks(spark, d, leak_ops.RUN_WORDS).where(f"matched >= {leak_ops.RUN_WORDS} and run_words >= {leak_ops.RUN_WORDS}").select("doc_id", "item_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that shares 8 unbroken words, with its longest common run and alignment score."""
    return _leaks(spark, d, leak_ops.SEED_WORDS)


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Edited, paraphrased and partial copies: alignments worth 15 words of the item, or three quarters of a shorter one, however often interrupted."""
    return p8_scores(spark, d).where(f"matched >= {leak_ops.RUN_WORDS} or score >= 0.75").select("doc_id", "item_id", "run_words", "score")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "tm_entries")
    return bitext.align_articles(entries, read(spark, d, "bitext_articles"), bitext.learn(entries))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one above the capacity, with its training sequence."""
    return packing.pack_documents(read(spark, d, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sequences, tokens and the share of room that stays empty."""
    per = p7_sequences(spark, d).groupBy("sequence_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest")).withColumn("empty_share", 1 - F.col("n_tokens") / (F.col("n_sequences") * packing.CAPACITY))


def _scorer(spark: SparkSession, d: str, documents: DataFrame) -> abuse.Scorer:
    return abuse.train_scorer(documents, "doc_id", "text", read(spark, d, "doc_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents")
    return abuse.scored(documents, "doc_id", "text", _scorer(spark, d, documents)).where(f"score >= {abuse.THRESHOLD}").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for every document."""
    documents = read(spark, d, "documents")
    return abuse.scored(documents, "doc_id", "text", _scorer(spark, d, documents))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of abusive documents per source."""
    documents = read(spark, d, "documents")
    return abuse.rates(documents, "doc_id", "text", "source", _scorer(spark, d, documents))


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_collapsed, p3_found, p4_found, p4_classes, p5_found, p5_pieces, p6_found, p6_classes, p6_unified, p7_sequences, p7_fill, p8_found, p8_scores, p8_edited, p9_found, p9_scores, p9_rates)}

_ORACLE_PLAIN = r"regexp_replace(lower({c}), '[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\s]+', '', 'g')"


def _groups_sql(table: str, key: str, source: str) -> str:
    keys = ", ".join(_ORACLE_PLAIN.format(c=c) if c != "priority" else c for c in RECORD)
    return f"SELECT '{table}' AS in_table, first_id, {key} AS copy_id FROM (SELECT {key}, min({key}) OVER (PARTITION BY {keys}) AS first_id FROM {source}) WHERE {key} <> first_id"


_RAW = "(SELECT raw_id, " + ", ".join(f"json_extract_string(line, '$.{c}') AS {c}" if c != "priority" else "CAST(json_extract_string(line, '$.priority') AS INTEGER) AS priority" for c in RECORD) + " FROM (SELECT raw_id, CASE WHEN json_valid(line) THEN line END AS line FROM raw_terms) WHERE line IS NOT NULL AND json_type(line) = 'OBJECT')"

ORACLE = {
    "p2_found": " UNION ALL ".join([_groups_sql("civil_code", "record_id", "civil_code"), _groups_sql("un_international", "record_id", "un_international"), _groups_sql("raw_terms", "raw_id", _RAW)]),
    "p5_found": "SELECT chunk_id FROM (SELECT chunk_id, length(text) AS n, length(text) - length(regexp_replace(text, '[؀-ۿ]', '', 'g')) AS a FROM context_chunks) WHERE greatest(1, a // 2 + (n - a) // 4) > 512",
}
