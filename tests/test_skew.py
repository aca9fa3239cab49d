from __future__ import annotations

from pyspark.sql import functions as F

from qirtas.plans.skew import grid_join, join_groups, keep_members, numbered


def test_skew_helpers(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2000, 0, id) as k")
    groups = rows.groupBy("k").count().where("count > 0")
    assert join_groups(rows, groups, "k", "count").count() == 3000
    members = spark.range(50).selectExpr("id * 7 as m")
    kept = {r.id for r in keep_members(rows, "id", members, "m").collect()}
    assert {i * 7 for i in range(50)} <= kept and len(kept) < 100
    got = numbered(rows, ["k"], ["id"], "n").collect()
    assert all(r.n == (r.id if r.k == 0 else 0) for r in got) and len(got) == 3000


def test_grid_join(spark):
    left = spark.range(300).selectExpr("id as a", "if(id < 200, 0, id) as k")
    right = spark.range(300).selectExpr("id as b", "if(id < 150, 0, id) as k")
    large = left.groupBy("k").count().where("count > 20")
    want = {tuple(r) for r in left.join(right, "k").select("k", "a", "b").collect()}
    got = [tuple(r) for r in grid_join(left, right, "k", F.col("a"), F.col("b"), large, "count", 20).select("k", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30000
    got = [tuple(r) for r in grid_join(left, right, "k", F.col("a"), F.col("b"), large.limit(0), "count", 20).select("k", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
