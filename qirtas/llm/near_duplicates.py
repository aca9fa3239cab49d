"""Near-duplicate records: a grouped prefix join on sets of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.llm.shingles import HASH_BITS, finish, shingle_sets, sums_by_row
from qirtas.plans.lineage import written
from qirtas.plans.skew import grid_join, join_groups, keep_members

#: Cells of the frequency sketch, a constant whatever the input.
SKETCH_CELLS = 1 << 21
#: Rows that a worker looks at together.
BLOCK = 2048
#: Words of the bitmap of a record's second text, 64 bits each.
BITMAP_WORDS = 3
#: Shared postings asked of a pair of groups, where its sizes guarantee so many.
SHARED = 5
#: Postings of a sequence, and classes of a group, that one task pairs; more are dealt out over a grid of tasks.
GRID_BLOCK = 20_000
#: Sequences and groups dealt out that way at most: where there would be more, the block grows, so their table stays small enough to broadcast.
MOST_LARGE = 100_000
#: Postings that one task of the prefix join reads from either side.
TASK_POSTINGS = 2_000_000
#: Mask of one of the sizes packed into a posting.
_LOW = (1 << 20) - 1
#: Rows whose two texts are the same characters, up to so many, are expanded to all pairs among them; of more, each is linked to the smallest id.
EXPAND_LIMIT = 50
#: Rows of a class that are paired together; a larger class is dealt out over several such blocks.
CLASS_BLOCK = 256


def _sketch(df: DataFrame, n: int) -> np.ndarray:
    """How often the word sequences of each hash cell occur in all rows: a fixed-size statistic."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH_CELLS, np.int64)
        for b in batches:
            for at in range(0, len(b), BLOCK):
                _, s = shingle_sets(b["_s"].iloc[at : at + BLOCK].tolist(), n)
                total += np.bincount((s % np.uint64(SKETCH_CELLS)).astype(np.int64), minlength=SKETCH_CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    counts = df.select("_s").mapInPandas(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SKETCH_CELLS, np.int64)
    sketch[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return sketch


def _bitmaps(rows: np.ndarray, s: np.ndarray, n_rows: int, words: int) -> list[np.ndarray]:
    """Parity bitmaps: the bits in which two of them differ bound from below how many elements the sets don't share."""
    bits = 64 * words
    at = (finish(s + np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(rows * bits + at, minlength=n_rows * bits) & 1).astype(np.uint8).reshape(n_rows, bits)
    packed = np.packbits(parity, axis=1, bitorder="little").view(np.int64)
    return [np.ascontiguousarray(packed[:, k]) for k in range(words)]


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 10 bits, which is all that the order of sequences needs."""
    return np.minimum(np.log2(counts + 1.0) * 24, 1023).astype(np.uint16)


def _signed(batches: Iterator[pd.DataFrame], scaled: np.ndarray, n: int, threshold: float):
    """Per block of rows: ids, sizes of both sets, group key, both sets, bitmaps, and the prefix postings (row, token, sketch cell)."""
    for whole in batches:
        for at in range(0, len(whole), BLOCK):
            b = whole.iloc[at : at + BLOCK]
            ids, size = b["_id"].to_numpy(), len(b)
            rt, st = shingle_sets(b["_t"].tolist(), n)
            rs, ss = shingle_sets(b["_s"].tolist(), n)
            n_s, n_t = np.bincount(rs, minlength=size), np.bincount(rt, minlength=size)
            # Row, frequency and the hash's low 40 bits in one key: one plain sort puts each row's rare sequences first.
            key = np.sort((rs.astype(np.uint64) << np.uint64(50)) | (scaled[(ss % np.uint64(SKETCH_CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (ss & np.uint64((1 << 40) - 1)))
            place = np.arange(len(rs)) - (np.cumsum(n_s) - n_s)[rs]
            inside = place < (n_s - np.ceil(threshold * n_s - 1e-9).astype(np.int64) + 1)[rs]
            rows, token = rs[inside], finish(key[inside] & np.uint64((1 << 40) - 1))
            # One group: the same prefix and sizes, and the same bitmap, which its one set of postings carries.
            bitmaps = _bitmaps(rt, st, size, BITMAP_WORDS)
            group = finish(sums_by_row(rows, token, size) + finish(n_s.astype(np.uint64) * np.uint64(1 << 20) + n_t.astype(np.uint64)))
            for w in bitmaps:
                group = finish(group ^ w.view(np.uint64))
            yield ids, n_s, n_t, (group >> np.uint64(32)).astype(np.uint32).view(np.int32), (rs, ss), (rt, st), bitmaps, rows, (token >> np.uint64(32)).astype(np.uint32).view(np.int32), (key[inside] & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def _alike(a: Column, b: Column, threshold: float, n: int) -> Column:
    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out, step = [], BLOCK // 2
        for at in range(0, len(x), step):
            one, two = x.iloc[at : at + step].tolist(), y.iloc[at : at + step].tolist()
            size = len(one)
            r, s = shingle_sets(one + two, n)
            n_of = np.bincount(r, minlength=2 * size)
            key = np.sort(((r % size).astype(np.uint64) << np.uint64(HASH_BITS)) | s)
            same = key[1:][key[1:] == key[:-1]] >> np.uint64(HASH_BITS)
            shared = np.bincount(same.astype(np.int64), minlength=size)
            out.append(shared >= threshold * (n_of[:size] + n_of[size:] - shared) - 1e-9)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return alike(a, b)


def near_duplicate_classes(df: DataFrame, id_col: str, first: str, second: str, n: int = 3, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of records alike in both texts.

    ``members``: ``id``, ``class_id`` for every row with both texts; rows with the
    same sets of word sequences in both texts share a class, named by its smallest id.
    ``links``: ``class_a`` < ``class_b``, all pairs of classes whose Jaccard
    similarity is at least ``threshold`` in ``first`` and in ``second``.

    Grouped prefix join. Records with the same prefix, sizes and bitmap collapse
    into one group before anything is shuffled by sequence. A group posts the
    rarest sequences of ``first``, ordered by a fixed-size frequency sketch over
    all rows (any order is exact, a rare-first one is fast). Group pairs that share
    postings pass exact filters by size, by position, by the bitmap of ``second``
    and by how many postings they share; then members are expanded and verified on
    their whole texts.
    Nothing is capped. Texts shorter than ``n`` words count as one sequence. Rows
    with a null id or text belong to no class; a repeated id counts once per class.
    """
    base = df.select(df[id_col].alias("_id"), df[first].alias("_s"), df[second].alias("_t")).where("_id is not null and _s is not null and _t is not null")
    sketch = _sketch(base, n)
    # Sequences that may be hot: the sketch counts a cell's sequences together, so it errs upwards only.
    broadcast = df.sparkSession.sparkContext.broadcast((_scaled(sketch), np.packbits(sketch > GRID_BLOCK)))

    def signed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        led: set[tuple[int, int]] = set()
        scaled, hot = broadcast.value
        hot = np.unpackbits(hot).astype(bool) if hot.any() else None
        for ids, n_s, n_t, group, (rs, ss), (rt, st), bitmaps, rows, token, cell in _signed(batches, scaled, n, threshold):
            size = len(ids)
            sets = finish(sums_by_row(rs, finish(ss + np.uint64(1)), size) + finish(sums_by_row(rt, finish(st + np.uint64(2)), size)))
            own = {f"b{k}": w for k, w in enumerate(bitmaps)}
            # A group posts once per partition, before anything is shuffled, however many copies it has there.
            tokens = np.split(token, np.searchsorted(rows, np.arange(1, size)))
            for i, key in enumerate(zip(group.tolist(), own["b0"].tolist(), strict=True)):
                if key in led:
                    tokens[i] = token[:0]
                led.add(key)
            maybe = [t[:0] for t in tokens] if hot is None else [t[hot[c]] for t, c in zip(tokens, (c[: len(t)] for t, c in zip(tokens, np.split(cell, np.searchsorted(rows, np.arange(1, size))), strict=True)), strict=True)]
            yield pd.DataFrame({"id": ids, "set_key": sets.view(np.int64), "g": group, "n_s": n_s.astype(np.int32), "n_t": n_t.astype(np.int32), "tokens": tokens, "maybe_hot": maybe} | own)

    own = ", ".join(f"b{k} bigint" for k in range(BITMAP_WORDS))
    signed = written(base.mapInPandas(signed_rows, f"id bigint, set_key bigint, g int, n_s int, n_t int, tokens array<int>, maybe_hot array<int>, {own}"), "signed")
    members = signed.select("id", "set_key", F.xxhash64("g", "b0").alias("group_key"))
    classes = members.groupBy("set_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"), F.first("group_key").alias("group_key"))
    t = threshold
    posting = F.posexplode("tokens").alias("place", "token")
    bitmaps = [f"b{k}" for k in range(BITMAP_WORDS)]
    postings = signed.select(posting, "g", "n_s", "n_t", *bitmaps).select("token", "g", (F.shiftleft(F.col("place").cast("bigint"), 40) + F.shiftleft(F.col("n_s").cast("bigint"), 20) + F.col("n_t")).alias("shape"), *bitmaps)
    n_postings = signed.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    block = max(GRID_BLOCK, n_postings // MOST_LARGE)
    large = written(signed.select(F.explode("maybe_hot").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(f"n > {block}"), "hot-sequences")
    hot = not large.isEmpty()

    def sided(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(df.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ["g", "shape", *bitmaps]]) for x in "pi")

    # Both sides of the join read one shuffle, in as many tasks as the postings need.
    cold = (postings.join(F.broadcast(large), "token", "left_anti") if hot else postings).repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_postings // TASK_POSTINGS), "token")
    a, b = sided(cold)
    met = a.join(b, "token")
    if hot:
        a, b = sided(postings.join(F.broadcast(large), "token", "left_semi"))
        met = met.unionByName(grid_join(a, b, "token", F.struct("g_p", "b0_p"), F.struct("g_i", "b0_i"), large, "n", block))
    share = t / (1 + t)
    overlap = f"ceil({share!r}D * (n_s_p + n_s_i) - 1e-9)"
    differ = " + ".join(f"bit_count(b{k}_p ^ b{k}_i)" for k in range(BITMAP_WORDS))
    # The k-th shared sequence is at most n - overlap + k - 1 places from the start on either side.
    # Every term looks at both sides, so none is pushed below the shuffle, which both sides share.
    condition = (
        f"(n_s_p > n_s_i or (n_s_p = n_s_i and (g_p < g_i or (g_p = g_i and b0_p < b0_i)))) and n_s_i >= {t!r}D * n_s_p - 1e-9 and place_i < n_s_i - {overlap} + {SHARED} and place_p < n_s_p - {overlap} + {SHARED}"
        f" and least(n_t_p, n_t_i) >= {t!r}D * greatest(n_t_p, n_t_i) - 1e-9 and (n_t_p + n_t_i - ({differ})) / 2 >= {share!r}D * (n_t_p + n_t_i) - 1e-9"
    )
    # So many of them lie in both prefixes, which are as long as the sizes' ratio needs at worst.
    asked = f"cast(least({SHARED}, 1 - ceil({t!r}D * n_s_p - 1e-9) + {overlap}) as int)"

    def unpacked(sql: str) -> Column:
        for x in "pi":
            sql = sql.replace(f"place_{x}", f"shiftright(shape_{x}, 40)").replace(f"n_s_{x}", f"(shiftright(shape_{x}, 20) & {_LOW})").replace(f"n_t_{x}", f"(shape_{x} & {_LOW})")
        return F.expr(sql)

    shared = met.where(unpacked(condition)).select(F.xxhash64("g_p", "b0_p").alias("g_a"), F.xxhash64("g_i", "b0_i").alias("g_b"), unpacked(asked).alias("asked"))
    group_pairs = shared.groupBy("g_a", "g_b").agg(F.count(F.lit(1)).alias("_n"), F.max("asked").alias("asked")).where("_n >= asked").select("g_a", "g_b")
    # Groups to classes: a group's members are expanded here, and pairs within a group added.
    side_a, side_b = (classes.select(F.col("group_key").alias(f"g_{x}"), F.col("class_id").alias(f"c_{x}")) for x in "ab")
    across = group_pairs.join(side_a, "g_a").join(side_b, "g_b").select("c_a", "c_b")
    several = classes.groupBy("group_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("group_key").alias("g_a"), "_n")
    inside = [keep.join(several.select("g_a"), "g_a", "left_semi") for keep in (side_a, side_b.withColumnRenamed("g_b", "g_a"))]
    wide = written(several.where(f"_n > {GRID_BLOCK}").orderBy(F.col("_n").desc()).limit(MOST_LARGE), "wide-groups")
    paired = inside[0].join(inside[1], "g_a") if wide.isEmpty() else grid_join(*inside, "g_a", F.col("c_a"), F.col("c_b"), wide, "_n", GRID_BLOCK)
    within = paired.where("c_a < c_b").select("c_a", "c_b")
    pairs = written(across.unionByName(within).where("c_a <> c_b").select(F.least("c_a", "c_b").alias("c_a"), F.greatest("c_a", "c_b").alias("c_b")), "class-pairs")
    involved = pairs.select(F.explode(F.array("c_a", "c_b")).alias("_c")).distinct()
    texts = keep_members(base, "_id", involved, "_c")
    both = pairs.join(texts.select(F.col("_id").alias("c_a"), F.col("_s").alias("s_a"), F.col("_t").alias("t_a")), "c_a")
    both = both.join(texts.select(F.col("_id").alias("c_b"), F.col("_s").alias("s_b"), F.col("_t").alias("t_b")), "c_b")
    links = both.where(_alike(F.col("s_a"), F.col("s_b"), t, n) & _alike(F.col("t_a"), F.col("t_b"), t, n)).select(F.col("c_a").alias("class_a"), F.col("c_b").alias("class_b"))
    membership = join_groups(members, classes.select("set_key", "class_id", "n_rows"), "set_key", "n_rows").select("id", "class_id", "n_rows")
    return membership, written(links.distinct(), "links")


def near_duplicate_pairs(df: DataFrame, id_col: str, first: str, second: str, n: int = 3, threshold: float = 0.5, expand_limit: int | None = EXPAND_LIMIT) -> DataFrame:
    """``id_a`` < ``id_b``: rows alike in both texts, copies included.

    Links of :func:`near_duplicate_classes` expanded to rows; classes of more than
    CLASS_BLOCK rows are dealt out over blocks, so no worker pairs a hot class
    alone. Between rows whose texts differ in any character every pair is there.
    Among more than ``expand_limit`` rows that are equal in both texts, character
    by character, each is linked to the smallest id only; with None these are
    expanded too. Rows with nulls have no pairs.
    """
    membership, links = near_duplicate_classes(df, id_col, first, second, n, threshold)
    membership = membership.distinct()
    if expand_limit is None:
        membership = membership.withColumn("lead", F.lit(None).cast("bigint"))
    else:
        large = membership.where(f"n_rows > {expand_limit}").select("id", "class_id")
        texts = df.select(df[id_col].alias("id"), F.sha2(F.concat_ws(":", F.length(df[first]), df[first], df[second]), 256).alias("_copy")).groupBy("id").agg(F.min("_copy").alias("_copy"))
        keyed = large.join(texts, "id")
        leads = keyed.groupBy("class_id", "_copy").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("_n")).where(f"_n > {expand_limit}").drop("_n")
        membership = membership.join(keyed.join(leads, ["class_id", "_copy"]).select("id", "class_id", "lead"), ["id", "class_id"], "left")
    # Parts of a class: its rows dealt out, copies of one text apart from the others.
    dealt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_rows") / CLASS_BLOCK))
    membership = written(membership.withColumn("part", F.when(F.col("lead").isNull(), dealt).otherwise(F.xxhash64("lead", dealt))), "membership")
    parts = membership.where(f"n_rows > {CLASS_BLOCK} or lead is not null").select("class_id").distinct().join(membership, "class_id").select("class_id", "part", "lead").distinct()
    units = links.unionByName(membership.where("n_rows > 1 and id = class_id").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    for x in "ab":
        units = units.join(parts.select(F.col("class_id").alias(f"class_{x}"), F.col("part").alias(f"part_{x}"), F.col("lead").alias(f"lead_{x}")), f"class_{x}", "left").withColumn(f"part_{x}", F.coalesce(f"part_{x}", F.lit(0)))
    units = units.where("class_a <> class_b or (part_a <= part_b and not coalesce(lead_a = lead_b, false))").select("class_a", "part_a", "class_b", "part_b")
    left, right = (membership.select(F.col("class_id").alias(f"class_{x}"), F.col("part").alias(f"part_{x}"), F.col("id").alias(x)) for x in "ab")
    met = units.join(left, ["class_a", "part_a"]).join(right, ["class_b", "part_b"]).where("class_a <> class_b or part_a <> part_b or a < b")
    pairs = met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    return pairs.unionByName(membership.where("lead is not null and id <> lead").select(F.col("lead").alias("id_a"), F.col("id").alias("id_b")))
