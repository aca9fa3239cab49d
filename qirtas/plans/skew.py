"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qirtas.plans.lineage import written

#: Keys joined by broadcast. The largest key left for the shuffle holds less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``), safe for hot keys.

    The HOT_KEYS largest groups by ``size`` are broadcast, a table bounded by that
    constant whatever the input; any other key holds under 1/HOT_KEYS of the rows
    and goes through an ordinary shuffle. Rows with a null key join nothing.
    """
    hot = groups.orderBy(F.col(size).desc(), F.col(key)).limit(HOT_KEYS)
    hot_keys = hot.select(F.col(key).alias("_hot_key"))
    near = rows.join(F.broadcast(hot), key)
    far_rows = rows.join(F.broadcast(hot_keys), F.col(key) == F.col("_hot_key"), "left_anti")
    return near.unionByName(far_rows.join(groups, key))


def grid_join(left: DataFrame, right: DataFrame, key: str, left_id: Column, right_id: Column, large: DataFrame, size: str, block: int) -> DataFrame:
    """Inner join on ``key`` in which the keys of ``large`` (one row per key, with its ``size``) are dealt out over a grid of cells.

    A large key's rows fall into ceil(size / block) parts by their id on either
    side, and every part of the left meets every part of the right in a cell of its
    own, so each pair of rows meets once and no task pairs a whole key. ``large`` is
    broadcast: the caller bounds it.
    """
    hot = F.broadcast(large.select(key, F.ceil(F.col(size) / block).cast("int").alias("_m")))

    def dealt(df: DataFrame, own: Column, at: str, over: str) -> DataFrame:
        parts = df.join(hot, key, "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
        return parts.withColumn(at, F.pmod(F.xxhash64(own), F.col("_m")).cast("int")).withColumn(over, F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m")

    return dealt(left, left_id, "_r", "_c").join(dealt(right, right_id, "_c", "_r"), [key, "_r", "_c"]).drop("_r", "_c")


#: Bits of the membership filter: 256 buckets of 4 KB each, 1 MB whatever the input.
FILTER_BITS = 1 << 23


def _filter_slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))


def keep_members(rows: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose ``column`` may occur in ``members``: a superset of the semi join.

    Members are hashed into a bitmap of FILTER_BITS bits, built by a distributed
    aggregation and broadcast at its fixed size, so big rows that cannot join
    need not be shuffled. False positives fall to the join that follows.
    """
    slot = _filter_slot(F.col(member))
    bitmap = (
        members.where(F.col(member).isNotNull())
        .select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_bit"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )
    slot = _filter_slot(F.col(column))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    tested = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmap), "_bucket")
    hit = F.floor(byte / F.pow(F.lit(2), (bit % 8).cast("int"))).cast("int") % 2 == 1
    return tested.where(hit).drop("_bucket", "_bitmap")


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: Column, column: str) -> DataFrame:
    """``df`` with ``column``: the sum of ``value`` over the rows before, within each group of ``keys`` by ``order``.

    Hot groups are split over tasks: rows are ranged by key and order and written
    once; each range sums up its own part of a group, and prefix sums over the
    ranges' totals (a row per group and range) give the offsets. Null keys are a
    group, nulls come first; ties in ``order`` are taken in any order.
    """
    valued = df.withColumn("_value", value.cast("bigint"))
    ranged = written(valued.repartitionByRange(*[F.col(c).asc() for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_value").alias("_n"))
    before = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).drop("_n")
    so_far = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_at", F.sum("_value").over(so_far) - F.col("_value"))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]])
    joined = local.alias("l").join(before.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._at") + F.col("r._before")).alias(column))


def numbered(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """``df`` with ``column``: 0, 1, ... within each group of ``keys`` by ``order``, by :func:`prefix_sums`."""
    return prefix_sums(df, keys, order, F.lit(1), column)
