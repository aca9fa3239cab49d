"""Glossary loading, conflicts, reverse terms, and the dictionary scan of texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qirtas.functions.text import normalize
from qirtas.plans.skew import numbered

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

TERM_DDL = "source_term string, source_lang string, target_term string, target_lang string, law_ref string, article_ref string, note string, priority int"
FILE_DDL = f"domain string, version string, last_updated string, terms array<struct<{', '.join(c.replace(' ', ': ', 1) for c in TERM_DDL.split(', '))}>>"

# What counts as a letter at a term's edges, and the clitics that may stand before an Arabic term.
LETTERS = "A-Za-z؀-ۿݐ-ݿ"
CLITICS = "بفلو"
NOISE = re.compile("[ً-ْـ]")
RUN = re.compile(f"[{LETTERS}]+")
_LETTER = re.compile(f"[{LETTERS}]")
_AR_FOLD = str.maketrans("أإآى", "اااي")


def read_glossary_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Terms of glossary JSON files with file, domain and a running order over the sorted files."""
    files = spark.read.schema(FILE_DDL).json(sorted(paths), multiLine=True).withColumn("file_path", F.input_file_name())
    rows = files.select("file_path", "domain", F.posexplode("terms").alias("pos", "t")).select("file_path", "domain", "pos", "t.*")
    ordered = numbered(rows, [], ["file_path", "pos"], "file_order")
    return ordered.withColumn("file_order", F.col("file_order").cast("int")).withColumn("priority", F.coalesce("priority", F.lit(0)))


def term_problem(df: DataFrame) -> Column:
    """Why a record is no valid term, null if it is: languages are 'ar' and 'en' and differ, terms are not blank."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank(df["source_term"]) | blank(df["target_term"]), "blank term")
        .when(~F.coalesce(df["source_lang"].isin("ar", "en") & df["target_lang"].isin("ar", "en"), F.lit(False)), "unknown language")
        .when(df["source_lang"] == df["target_lang"], "same language")
        .when(df["law_ref"].isNull(), "missing law_ref")
    )


def file_problems(files: DataFrame) -> DataFrame:
    """``file_path, problem`` of glossary files (``file_path, content``) that have one: no JSON object, a missing head, no terms, a bad term, a key twice.

    A file is one row: glossaries are written by hand. The first problem of each kind is named.
    """
    text = F.col("content")
    parsed = F.from_json(text, FILE_DDL)
    fields = F.json_object_keys(text)
    missing = F.array_except(F.array(*[F.lit(f) for f in ("domain", "version", "last_updated", "terms")]), fields)
    head = (
        F.when(F.coalesce(fields.isNull(), F.lit(True)), "root is not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required field "), F.array_join(missing, ", ")))
        .when(F.coalesce(F.size(parsed["terms"]), F.lit(0)) <= 0, "terms must be a non-empty array")
    )
    heads = files.select("file_path", head.alias("problem"), parsed.alias("_p"))
    terms = heads.where("problem is null").select("file_path", F.posexplode("_p.terms").alias("pos", "t")).select("file_path", "pos", "t.*")
    terms = terms.withColumn("source_term_norm", F.when(F.col("source_lang").isin("ar", "en"), normalize(F.col("source_term"), F.when(F.col("source_lang").isin("ar", "en"), F.col("source_lang")))))
    bad = terms.withColumn("problem", term_problem(terms)).where("problem is not null")
    first = bad.groupBy("file_path").agg(F.min(F.struct("pos", "problem")).alias("b")).select("file_path", F.concat(F.lit("term "), F.col("b.pos").cast("string"), F.lit(": "), F.col("b.problem")).alias("problem"))
    twice = duplicate_keys(terms.where("source_term_norm is not null")).groupBy("file_path").agg(F.min("source_term_norm").alias("_k")).select("file_path", F.concat(F.lit("key twice: "), F.col("_k")).alias("problem"))
    return heads.where("problem is not null").select("file_path", "problem").unionByName(first).unionByName(twice)


def load_glossary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """:func:`read_glossary_files` with normalised forms, all or nothing: any problem in any file is an error that names them."""
    files = spark.read.text(sorted(paths), wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("content"))
    problems = file_problems(files).orderBy("file_path", "problem").limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r.file_path}: {r.problem}" for r in problems))
    rows = read_glossary_files(spark, paths)
    return rows.withColumn("source_term_norm", normalize(F.col("source_term"), F.col("source_lang"))).withColumn("term_id", F.col("file_order").cast("bigint"))


def with_reverse(terms: DataFrame) -> DataFrame:
    """Explicit terms, and the terms derived from them the other way round behind them: ``derived`` tells which."""
    columns = ["term_id", "file_order", "source_term", "source_lang", "target_term", "target_lang", "source_term_norm"]
    return terms.select(*columns, F.lit(False).alias("derived")).unionByName(reverse_terms(terms).select(*columns, F.lit(True).alias("derived")))


def duplicate_keys(terms: DataFrame) -> DataFrame:
    """Keys that occur more than once within a file."""
    return terms.groupBy("file_path", "source_term_norm", "source_lang", "target_lang").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def winners(terms: DataFrame) -> DataFrame:
    """One term per (language, normalised form): priority, then length, then a law reference, then order."""
    order = [F.col("priority").desc(), F.length("source_term").desc(), (F.coalesce("law_ref", F.lit("")) != "").desc(), "file_order", "term_id"]
    return terms.where("source_term_norm is not null").withColumn("_r", F.row_number().over(Window.partitionBy("source_lang", "source_term_norm").orderBy(*order))).where("_r = 1").drop("_r")


def reverse_terms(terms: DataFrame) -> DataFrame:
    """Swapped terms whose key no explicit term has; the first by order of each derived key."""
    known = terms.where(F.col("target_lang").isin("ar", "en") & F.col("target_term").isNotNull())
    swapped = known.select("term_id", "file_order", F.col("target_term").alias("source_term"), F.col("target_lang").alias("source_lang"), F.col("source_term").alias("target_term"), F.col("source_lang").alias("target_lang"))
    swapped = swapped.withColumn("source_term_norm", normalize(F.col("source_term"), F.col("source_lang")))
    keys = ["source_term_norm", "source_lang", "target_lang"]
    derived = swapped.join(terms.select(*keys), keys, "left_anti")
    first = Window.partitionBy(*keys).orderBy("file_order", "term_id")
    return derived.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


#: Characters of a term's key; a shorter term's key is its first run of letters.
KEY_CHARS = 10
#: Bits of the bitmap of term keys that every worker holds, whatever the number of terms.
KEY_BITS = 1 << 22
_OTHER = re.compile(f"[^\\s{LETTERS}]")


def _slot(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % KEY_BITS


def _shown(text: str, lang: str) -> tuple[str, list[int] | None]:
    """(normalised text, its characters' places in the original if they differ)."""
    if lang == "ar":
        if not NOISE.search(text):
            return text.translate(_AR_FOLD), None
        places = [i for i, c in enumerate(text) if not NOISE.match(c)]
        return "".join(text[i] for i in places).translate(_AR_FOLD), [*places, len(text)]
    shown = text.lower()
    return (shown if len(shown) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)), None


def _begins(shown: str, places: list[int] | None, p: int, lang: str) -> bool:
    """Whether a term may begin at ``p``: not within a word, but behind an Arabic clitic. A mark just before is a letter too, and blocks."""
    if p == 0:
        return True
    before = shown[p - 1]
    if not _LETTER.match(shown[p]):
        return not _LETTER.match(before)
    if places is not None and places[p] - 1 != places[p - 1]:
        return False
    return not _LETTER.match(before) or (lang == "ar" and before in CLITICS)


def _starts(text: str, lang: str) -> tuple[str, list[int] | None, list[int]]:
    """(normalised text, its characters' places in the original if they differ, where a term may begin)."""
    shown, places = _shown(text, lang)
    out = [m.start() for m in _OTHER.finditer(shown)]
    for m in RUN.finditer(shown):
        out.append(m.start())
        if lang == "ar":
            out += [p for p in range(m.start() + 1, m.end()) if shown[p - 1] in CLITICS]
    return shown, places, sorted(p for p in out if _begins(shown, places, p, lang))


def _keys(shown: str, p: int) -> tuple[str, str]:
    m = RUN.match(shown, p)
    return shown[p : p + KEY_CHARS], m[0] if m else shown[p]


#: Terms, and characters of terms, up to which the dictionary is broadcast; beyond, texts and terms are joined.
DICTIONARY_TERMS, DICTIONARY_CHARS = 200_000, 8_000_000
_CARRIED = ["source_term_norm", "term_id", "target_term", "target_lang", "law_ref", "article_ref", "note", "priority"]


def _keyed(terms: DataFrame) -> DataFrame:
    """Winning terms with the key by which a text finds them."""
    best = winners(terms).where("source_lang in ('ar', 'en') and source_term_norm <> ''")
    run = F.regexp_extract("source_term_norm", f"^[{LETTERS}]+", 0)
    short = F.when(run == "", F.substring("source_term_norm", 1, 1)).otherwise(run)
    return best.withColumn("_key", F.when(F.length("source_term_norm") >= KEY_CHARS, F.substring("source_term_norm", 1, KEY_CHARS)).otherwise(short))


def candidates(docs: DataFrame, terms: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Places where a winning term stands between boundaries: ``doc_id``, ``char_start``, ``char_end`` and the term.

    Where a word begins, its first characters are looked up in a fixed-size bitmap
    of term keys; survivors equi-join the terms on that key, so the dictionary
    needn't fit anywhere. Next to a term there must be no letter; an Arabic term
    may follow a clitic. Marks behind an Arabic term belong to it. Documents and
    terms in other languages, null texts and blank terms match nothing.
    """
    best = _keyed(terms)
    keys = best.select(F.pmod(F.crc32(F.encode("_key", "UTF-8")), F.lit(KEY_BITS)).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bitmap = np.zeros(KEY_BITS, bool)
    bitmap[keys] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())
    longest = best.agg(F.max(F.length("source_term_norm"))).first()[0] or 0

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        cache: dict[str, bool] = {}

        def hit(k: str) -> bool:
            found = cache.get(k)
            if found is None:
                if len(cache) > 500_000:
                    cache.clear()
                slot = _slot(k)
                found = cache[k] = bool(known[slot >> 3] >> (7 - (slot & 7)) & 1)
            return found

        for b in batches:
            out = []
            for i, x, g in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                shown, places, at = _starts(x, g)
                for p in at:
                    for k in dict.fromkeys(_keys(shown, p)):
                        if hit(k):
                            end = min(p + longest, len(shown))
                            own = list(range(p, end + 1)) if places is None else places[p : end + 1]
                            after = [x[e : e + 1] for e in own]
                            out.append((i, g, own[0], k, shown[p:end], own, "".join(c or "\n" for c in after)))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "char_start", "_key", "_text", "_places", "_after"])

    base = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang")).where("text is not null and lang in ('ar', 'en')")
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, lang string, char_start int, _key string, _text string, _places array<int>, _after string"
    found = base.mapInPandas(starts, schema)
    chosen = best.select(F.col("source_lang").alias("lang"), "_key", "source_term_norm", "term_id", "target_term", "target_lang", "law_ref", "article_ref", "note", "priority")
    hits = found.join(chosen, ["lang", "_key"]).where("startswith(_text, source_term_norm)")
    size = F.length("source_term_norm")
    # The place after the term's last character that is no mark: marks in between are absorbed.
    ended = hits.withColumn("char_end", F.col("_places")[size]).where(~F.substring("_after", size + 1, F.lit(1)).rlike(f"[{LETTERS}]"))
    return ended.drop("_key", "_text", "_places", "_after")


Finder = Callable[[str], Iterable[tuple[int, str]]]


def automaton_finder(terms: Iterable[str]) -> Finder:
    """Places and terms of all occurrences, by an Aho-Corasick automaton."""
    own = ahocorasick.Automaton()
    for t in terms:
        own.add_word(t, t)
    own.make_automaton()
    return lambda shown: ((end - len(t) + 1, t) for end, t in own.iter(shown))


def pattern_finder(terms: Iterable[str]) -> Finder:
    """The same by one regular expression for the keys of the terms, for workers without the automaton's library."""
    by_key: dict[str, list[str]] = {}
    for t in terms:
        by_key.setdefault(t[:3], []).append(t)
    starts = re.compile("(?=(" + "|".join(map(re.escape, sorted(by_key, key=len, reverse=True))) + "))")

    def find(shown: str) -> Iterator[tuple[int, str]]:
        for m in starts.finditer(shown):
            p = m.start()
            # A shorter key may hide behind a longer one.
            for n in range(1, len(m[1]) + 1):
                for t in by_key.get(m[1][:n], ()):
                    if shown.startswith(t, p):
                        yield p, t

    return find


def finder(terms: Iterable[str]) -> Finder:
    return automaton_finder(terms) if ahocorasick is not None else pattern_finder(terms)


def _kept(text: str, lang: str, find: Finder) -> list[tuple[int, int, str]]:
    """(start, end, term) of the occurrences between boundaries, left to right, the longest at each place, none overlapping."""
    shown, places = _shown(text, lang)
    met = []
    for p, t in find(shown):
        stop = p + len(t)
        start, end = (p, stop) if places is None else (places[p], places[stop])
        if not _LETTER.match(text, end) and _begins(shown, places, p, lang):
            met.append((start, -len(t), end, t))
    out, done = [], 0
    for start, _, end, t in sorted(met):
        if start >= done:
            out.append((start, end, t))
            done = end
    return out


def _scan_broadcast(docs: DataFrame, best: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """:func:`scan` with a dictionary of a measured size in every task: one pass, no shuffle."""
    chosen = best.select(F.col("source_lang").alias("lang"), "_key", *_CARRIED)
    index: dict[str, dict[str, tuple]] = {}
    for r in chosen.collect():
        index.setdefault(r["lang"], {})[r["source_term_norm"]] = tuple(r[c] for c in _CARRIED)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finders = {g: finder(own) for g, own in shared.value.items()}
        for b in batches:
            out = []
            for i, x, g in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                if g in finders:
                    out += [(i, g, start, end, *shared.value[g][term]) for start, end, term in _kept(x, g, finders[g])]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "char_start", "char_end", *_CARRIED])

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    base = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang")).where("text is not null and lang in ('ar', 'en')")
    return base.mapInPandas(run, f"doc_id {docs.schema[key].dataType.simpleString()}, lang string, char_start int, char_end int, " + ", ".join(f"{c} {kinds[c]}" for c in _CARRIED))


def scan(docs: DataFrame, terms: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Hits of :func:`candidates` from left to right, the longest at each place, none overlapping.

    A dictionary of at most DICTIONARY_TERMS terms and DICTIONARY_CHARS characters,
    both counted first, travels to the texts; a larger one is joined with them,
    with the same result. There a document's candidates are folded in one task:
    their number is bounded by the document's words, not by the collection.
    """
    best = _keyed(terms)
    size = best.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("source_term_norm") + sum(F.coalesce(F.length(c), F.lit(0)) for c in _CARRIED if c in ("target_term", "law_ref", "article_ref", "note"))), F.lit(0)).alias("c")).first()
    if size["n"] <= DICTIONARY_TERMS and size["c"] <= DICTIONARY_CHARS:
        return _scan_broadcast(docs, best, key, text, lang)
    found = candidates(docs, terms, key, text, lang)
    fields = [c for c in found.columns if c not in ("doc_id", "lang")]
    entry = F.struct("char_start", (-F.length("source_term_norm")).alias("_order"), "char_end", *[c for c in fields if c not in ("char_start", "char_end")])
    per = found.groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    kind = per.schema["_all"].dataType.simpleString()
    fold = F.expr(f"aggregate(_all, named_struct('at', 0, 'kept', cast(array() as {kind})), (acc, x) -> if(x.char_start < acc.at, acc, named_struct('at', x.char_end, 'kept', concat(acc.kept, array(x))))).kept")
    return per.select("doc_id", "lang", F.explode(fold).alias("h")).select("doc_id", "lang", *[F.col(f"h.{c}").alias(c) for c in fields])
