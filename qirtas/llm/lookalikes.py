"""Texts that look the same but differ in their characters, brought to one consistent form."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.plans.lineage import written
from qirtas.plans.skew import grid_join, join_groups, keep_members

#: Variants of more rows than this are represented by their smallest key when pairs are listed.
EXPAND_LIMIT = 50
#: Rows of a class that one task pairs, and classes dealt out over several tasks at most.
CLASS_BLOCK, MOST_LARGE = 2_000, 100_000

# Letters of other scripts that share the shape of a Latin letter, then Arabic letters that share a shape.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏк", "ABESIJKMHOPCTYXaesijopcyxhdqwlk")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳαρκ", "ABEZHIKMNOPTYXvocjapk")
ARMENIAN = ("ՕՍՏօսոհց", "OUSounhg")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB")
LATIN_LIKE = ("ıɡɑᴏᴜᴠᴡᴢ‐‑", "igaouvwz--")
ARABIC = ("کیۀەہھګڪ۰۱۲۳۷۸۹", "كيةهههكك٠١٢٣٧٨٩")
# Ligatures of several letters.
LIGATURES = {"ﻵ": "لآ", "ﻶ": "لآ", "ﻷ": "لأ", "ﻸ": "لأ", "ﻹ": "لإ", "ﻺ": "لإ", "ﻻ": "لا", "ﻼ": "لا", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Ranges of letters, digits and marks that are neither mapped nor composed, and of composed ones that are not mapped.
BARE = r"\t-\x7e\u00a1-\u00ac\u00ae-\u00b4\u00b6-\u00bf\u060c\u061b\u061f\u0621\u0627-\u063a\u0641-\u064a\u0660-\u0669\u0e01-\u0e30\u0e32\u0e40-\u0e46\u2013-\u2014\u2018-\u201f\u2026\u3001-\u3002\u300a-\u3011\u4e00-\u9fff"
ACCENTED = r"\u00c0-\u0130\u0132-\u024f\u0622-\u0626\u064b-\u0652\u0e31\u0e33-\u0e3a\u0e47-\u0e4e"
INVISIBLE = r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠍ㅤ︀-️ﾠ]+"


def _width_and_shape() -> dict[str, str]:
    """Characters whose compatibility form is one other character of another width or shape: by rule from Unicode data."""
    out = {}
    for start, end in ((0xFB50, 0xFE00), (0xFE70, 0xFEFD), (0xFF01, 0xFFEF), (0x2000, 0x2010), (0x3000, 0x3001), (0xA0, 0xA1), (0x202F, 0x2030), (0x205F, 0x2060), (0x1680, 0x1681), (0x2102, 0x213A), (0x2145, 0x214A), (0x2170, 0x2180), (0x1D400, 0x1D800), (0x1EE00, 0x1EEBC)):
        for code in range(start, end):
            c = chr(code)
            plain = " " if unicodedata.category(c) == "Zs" else unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c:
                out[c] = plain
    return out


def mapping() -> tuple[str, str]:
    """The two arguments of ``translate``: shapes and widths first, then letters that share a shape."""
    table = _width_and_shape()
    for source, target in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LATIN_LIKE, ARABIC):
        table |= dict(zip(source, target, strict=True))
    table = {k: table.get(v, v) for k, v in table.items()}
    return "".join(table), "".join(table.values())


def look(text: Column) -> Column:
    """``text`` with invisible characters removed and look-alikes mapped to one character; null for null."""
    source, target = mapping()
    mapped = F.regexp_replace(text, INVISIBLE, "")
    for ligature, letters in LIGATURES.items():
        mapped = F.replace(mapped, F.lit(ligature), F.lit(letters))
    # Most texts hold nothing to map, which one search tells.
    return F.when(text.rlike(f"[^{BARE}{ACCENTED}]"), F.translate(mapped, source, target)).otherwise(text)


def _digits(look_col: Column) -> Column:
    """Digits as they are: the collation takes digits of any script for equal, the eye doesn't."""
    return F.regexp_replace(look_col, r"[^\p{Nd}]+", "")


def _base_letters() -> tuple[str, str]:
    """Composed letters and their base letters, by rule from Unicode data."""
    table = {}
    for start, end in ((0xC0, 0x250), (0x370, 0x530), (0x620, 0x700), (0x1E00, 0x2000)):
        for code in range(start, end):
            plain = unicodedata.normalize("NFD", chr(code))
            if len(plain) > 1 and all(unicodedata.combining(c) for c in plain[1:]):
                table[chr(code)] = plain[0]
    return "".join(table), "".join(table.values())


def look_key(text: Column) -> Column:
    """64-bit key that texts of one look share: the hash of the mapped look without accents.

    Spark's hash doesn't follow a collation, so this key is coarser than the look
    (it ignores accents) and the collation decides among texts that share it.
    """
    source, target = _base_letters()
    accented = F.regexp_replace(F.translate(look(text), source, target), r"\p{Mn}+", "")
    return F.xxhash64(F.when(text.rlike(f"[^{BARE}]"), accented).otherwise(text))


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of classes in which several different texts look the same: ``row_key``, ``text``, ``class_key``, ``variant_key``, ``n_rows``.

    Only 64-bit keys of all rows are shuffled, pre-aggregated; texts are fetched
    for rows of classes with several texts alone, through a fixed-size bitmap, and
    grouped there under accent-sensitive Unicode collation. ``variant_key``
    names the exact text, ``n_rows`` counts its rows. Null keys and texts belong to
    no class. Classes keep their members whole, however many.
    """
    base = df.select(df[key].cast("bigint").alias("row_key"), df[text].alias("text")).where("row_key is not null and text is not null")
    keyed = written(base.select("row_key", look_key(F.col("text")).alias("class_key"), F.xxhash64("text").alias("variant_key")), "look-keys")
    variants = keyed.groupBy("class_key", "variant_key").agg(F.count(F.lit(1)).alias("n_rows"))
    classes = variants.groupBy("class_key").agg(F.count(F.lit(1)).alias("_variants"), F.sum("n_rows").alias("_rows")).where("_variants > 1").select("class_key", "_rows")
    members = written(join_groups(keyed, classes, "class_key", "_rows").select("row_key", "class_key", "variant_key"), "look-members")
    texts = keep_members(base, "row_key", members.select("row_key").distinct(), "row_key").select("row_key", "text", F.xxhash64("text").alias("variant_key"))
    full = written(members.join(texts, ["row_key", "variant_key"]), "look-texts")
    # Accent-sensitive Unicode collation groups the distinct texts of a class; digits of other scripts stay apart.
    distinct = full.groupBy("class_key", "variant_key").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n_rows"))
    # Looks are computed once, spread by key rather than by bytes, since each is costly and short.
    spread = distinct.repartition("class_key", "variant_key").withColumn("_look", look(F.col("text")))
    shown = written(spread.select("class_key", "variant_key", "n_rows", F.col("_look"), _digits(F.col("_look")).alias("_digits")), "looks")
    collated = shown.withColumn("_shown", F.collate("_look", "UNICODE"))
    groups = collated.groupBy("class_key", "_shown", "_digits").agg(F.min("variant_key").alias("_first"), F.count(F.lit(1)).alias("_variants")).where("_variants > 1").drop("_variants")
    refined = written(collated.join(groups, ["class_key", "_shown", "_digits"]).select("class_key", "variant_key", "n_rows", F.xxhash64("class_key", "_first").alias("_class")), "look-classes")
    found = join_groups(full.withColumn("_variant", F.struct("class_key", "variant_key")), refined.select(F.struct("class_key", "variant_key").alias("_variant"), "n_rows", "_class"), "_variant", "n_rows")
    return written(found.select("row_key", "text", F.col("_class").alias("class_key"), "variant_key", "n_rows"), "look-rows")


def unify(df: DataFrame, key: str, text: str) -> DataFrame:
    """``row_key``, ``text``, ``canonical``: one consistent form of every text.

    Texts are grouped by their mapped look under accent-sensitive Unicode
    collation; the canonical member of a class is the one closest to its mapped
    look, ties to the smallest in code point order, and is joined back. A text
    that no other looks like keeps its mapped look. Null texts stay null; letter
    case, accents, ordinary spaces and line breaks are kept apart.
    """
    classes = look_classes(df, key, text)
    distance = F.levenshtein(F.col("text"), look(F.col("text")))
    best = classes.select("class_key", "text", distance.alias("_d")).groupBy("class_key").agg(F.min(F.struct("_d", "text")).alias("_best")).select("class_key", F.col("_best.text").alias("_canonical"))
    chosen = join_groups(classes.select("row_key", "class_key"), best.withColumn("_n", F.lit(1)), "class_key", "_n").select(F.col("row_key").alias("_k"), "_canonical").distinct()
    base = df.select(df[key].cast("bigint").alias("row_key"), df[text].alias("text"))
    return base.join(chosen, F.col("row_key") == F.col("_k"), "left").select("row_key", "text", F.coalesce("_canonical", look(F.col("text"))).alias("canonical"))


def _same_look(a: Column, b: Column) -> Column:
    la, lb = look(a), look(b)
    return (F.collate(la, "UNICODE") == F.collate(lb, "UNICODE")) & (_digits(la) == _digits(lb))


def look_pairs(df: DataFrame, key: str, text: str, expand_limit: int = EXPAND_LIMIT) -> DataFrame:
    """``row_key`` < ``twin_key``: rows whose texts look the same but differ in characters.

    Rows with equal texts are no pair. A text that occurs in more than
    ``expand_limit`` rows stands in the pairs by its smallest key, so no link
    between different texts is lost and copies don't multiply.
    """
    rows = look_classes(df, key, text)
    lead = rows.where(f"n_rows > {expand_limit}").groupBy("class_key", "variant_key").agg(F.min("row_key").alias("row_key"))
    shown = written(rows.where(f"n_rows <= {expand_limit}").select("class_key", "row_key", "variant_key").unionByName(lead.select("class_key", "row_key", "variant_key")), "look-shown")
    # Classes of many rows are dealt out over cells; the largest ones, a bounded number, by broadcast of their sizes.
    large = shown.groupBy("class_key").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {CLASS_BLOCK}").orderBy(F.col("_n").desc()).limit(MOST_LARGE)
    a = shown.select("class_key", F.col("row_key").alias("row_a"), F.col("variant_key").alias("v_a"))
    b = shown.select("class_key", F.col("row_key").alias("row_b"), F.col("variant_key").alias("v_b"))
    pairs = grid_join(a, b, "class_key", F.col("row_a"), F.col("row_b"), large, "_n", CLASS_BLOCK).where("row_a < row_b and v_a <> v_b")
    return pairs.select(F.col("row_a").alias("row_key"), F.col("row_b").alias("twin_key")).distinct()


def look_matches(df: DataFrame, key: str, text: str, other: DataFrame, other_key: str, other_text: str, expand_limit: int = EXPAND_LIMIT) -> DataFrame:
    """``row_key`` of ``df`` and ``twin_key`` of ``other`` whose texts look the same but differ in characters.

    Distinct texts are matched first; rows join them by the exact text, the most
    frequent texts by a bounded broadcast. A text that occurs in more than
    ``expand_limit`` rows of ``other`` is found by its smallest key there. Nulls
    match nothing.
    """
    rows = df.select(df[key].cast("bigint").alias("row_key"), df[text].alias("text")).where("row_key is not null and text is not null")
    texts = written(rows.groupBy("text").agg(F.count(F.lit(1)).alias("_n")).withColumn("class_key", look_key(F.col("text"))), "look-asked")
    others = other.select(other[other_key].cast("bigint").alias("twin_key"), other[other_text].alias("_t")).where("twin_key is not null and _t is not null")
    known = written(others.groupBy("_t").agg(F.count(F.lit(1)).alias("_m"), F.min("twin_key").alias("_lead")).withColumn("class_key", look_key(F.col("_t"))), "look-known")
    found = written(texts.join(known, "class_key").where("text <> _t").where(_same_look(F.col("text"), F.col("_t"))).select("text", "_n", "_t", "_m", "_lead"), "look-met")
    few = found.where(f"_m <= {expand_limit}")
    twins = join_groups(others, few.select("_t", "_m").distinct(), "_t", "_m").groupBy("_t").agg(F.collect_set("twin_key").alias("_twins"))
    paired = few.join(twins, "_t").select("text", "_n", F.explode("_twins").alias("twin_key")).unionByName(found.where(f"_m > {expand_limit}").select("text", "_n", F.col("_lead").alias("twin_key")))
    # One row per text of the asking side, whose partners are few: spellings of one look, each of at most expand_limit rows.
    grouped = paired.groupBy("text").agg(F.collect_set("twin_key").alias("_twins"), F.max("_n").alias("_n"))
    return join_groups(rows, grouped, "text", "_n").select("row_key", F.explode("_twins").alias("twin_key")).distinct()
