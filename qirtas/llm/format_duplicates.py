"""Records that differ only in white space, letter case, punctuation or field order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.plans.lineage import written
from qirtas.plans.skew import join_groups, keep_members

#: White space, punctuation, symbols, separators and invisible format characters.
IGNORED = r"[\p{P}\p{S}\p{Z}\p{C}\s]+"


def plain(text: Column) -> Column:
    """Text with letter case, white space and punctuation disregarded; null stays null."""
    return F.regexp_replace(F.lower(text.cast("string")), IGNORED, "")


#: Letters that the cheap pass counts, dealt over so many counters.
LETTERS, COUNTERS = "aeiourstnlcdmاليمنرتوهبعدسقفحك的人一法", 4


def _invariant(fields: Sequence[Column]) -> Column:
    """Hash of what formatting can't change and one look at the raw text tells: how many letters there are, and of which kinds."""
    joined = F.lower(F.concat_ws("", *fields))
    return F.xxhash64(*[F.length(joined) - F.length(F.translate(joined, LETTERS[i::COUNTERS], "")) for i in range(COUNTERS)])


def format_duplicate_groups(df: DataFrame, id_col: str, fields: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Every row of a class with several members: columns ``within``, ``member_id``, ``first_id``, ``n_copies``.

    Two rows are the same if all ``fields`` are equal once white space, letter
    case and punctuation are disregarded, and the columns ``within`` as they are;
    null equals only null, so an empty or all-punctuation text differs from null.
    ``first_id`` is the smallest id.

    Partition refinement. The first pass groups the raw rows by invariants that
    need no normalising: counts of letters, after which only 64-bit hashes are
    shuffled, counted on the map side. Classes with several rows set a bitmap of
    fixed size, and only rows that it lets through get the full normalised key,
    which decides. Hot classes are split by
    :func:`qirtas.plans.skew.join_groups`. Rows with a null id are left out, an id
    that occurs twice counts as two copies. Other columns are ignored, whatever
    their names.
    """
    names = [f"_f{i}" for i in range(len(fields))]
    parts = [f"_w{i}" for i in range(len(within))]
    base = df.select(F.col(id_col).alias("member_id"), *[df[c].alias(p) for c, p in zip(within, parts, strict=True)], *[df[c].cast("string").alias(n) for c, n in zip(fields, names, strict=True)]).where("member_id is not null")
    # Both passes read the invariants, so they are computed once.
    cheap = written(base.withColumn("_class", F.xxhash64(_invariant([F.col(n) for n in names]), *parts)), "format-classes")
    classes = cheap.groupBy("_class").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1").select(F.col("_class").alias("_several"))
    suspects = keep_members(cheap, "_class", classes, "_several")
    # The exact key: the normalised fields themselves, nulls kept apart, behind a 256-bit digest.
    exact = F.sha2(F.to_json(F.struct(*parts, *[plain(F.col(n)).alias(n) for n in names]), {"ignoreNullFields": "false"}), 256)
    keyed = written(suspects.select("member_id", *parts, exact.alias("_exact")), "format-keys")
    groups = keyed.groupBy("_exact").agg(F.min("member_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return join_groups(keyed, groups, "_exact", "n_copies").select(*[F.col(p).alias(c) for c, p in zip(within, parts, strict=True)], "member_id", "first_id", "n_copies")


def collapse_format_duplicates(df: DataFrame, id_col: str, fields: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One record per class, the one with the smallest id, with ``n_copies``.

    Built on :func:`format_duplicate_groups`; rows without a twin have
    ``n_copies`` 1. A column of the input named ``n_copies`` is replaced.
    """
    twins = format_duplicate_groups(df, id_col, fields, within).distinct()
    renamed = twins.select(F.col("member_id").alias("_member"), "first_id", F.col("n_copies").alias("_copies"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)])
    on = df[id_col] == renamed["_member"]
    for i, c in enumerate(within):
        on = on & df[c].eqNullSafe(renamed[f"_w{i}"])
    marked = df.drop("n_copies").join(renamed, on, "left")
    kept = marked.where(F.col("_member").isNull() | (F.col(id_col) == F.col("first_id")))
    return kept.withColumn("n_copies", F.coalesce("_copies", F.lit(1).cast("bigint"))).drop("_member", "first_id", "_copies", *[f"_w{i}" for i in range(len(within))])
