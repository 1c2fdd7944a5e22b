"""Joins of tables in which one key holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from catalumen.operators.components import connected_components
from catalumen.runtime import block_join, hot_hashes, settled, skew_join, spread


def third(spark, n, name):
    """n rows, a third of them with key 7, some with a null key."""
    k = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 5000).cast("long")
    return spark.range(n).select(k.alias("k"), F.col("id").alias(name))


def test_hot_keys_are_found(spark):
    df = third(spark, 9000, "i")
    assert hot_hashes(df, ["k"]) == [df.filter("k = 7").select(F.xxhash64("k")).head()[0]]
    assert hot_hashes(df.limit(0), ["k"]) == [] and hot_hashes(df.filter("k is null"), ["k"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_with_many_null_keys(spark, how):
    left = third(spark, 6000, "i").unionByName(spark.range(4000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("i")))
    right = spark.createDataFrame([(k, f"v{k}") for k in (*range(40), None)], "k long, v string")
    got, want = skew_join(left, right, ["k"], how), left.join(right, ["k"], how)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_block_join_gives_every_pair_once(spark):
    a, b = third(spark, 3000, "i"), third(spark, 2400, "j")
    got, want = block_join(a, b, ["k"], "i", "j", rows=100), a.join(b, "k")
    assert got.columns == want.columns
    assert got.count() == want.count() and got.distinct().count() == got.count()
    assert block_join(a, b.limit(0), ["k"], "i", "j").count() == 0
    # the hot key's rows of either side are in cells of about 100 x 100 rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_block_join_of_sides_that_share_other_names(spark):
    """A hot key's rows come out beside the others', where both sides have a column of one name besides the keys."""
    a, b = (third(spark, 900, i).withColumn("name", F.lit(i)) for i in ("i", "j"))
    got, want = block_join(a, b, ["k"], "i", "j", rows=100), a.join(b, "k")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_of_a_hot_key_meet_in_several_tasks(spark):
    """However few bytes the blocks are, their pairs come from many tasks."""
    a, b = third(spark, 3000, "i"), third(spark, 2400, "j")
    got = block_join(a, b, ["k"], "i", "j", rows=100).filter("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in got) == 1001 * 801 and max(r["count"] for r in got) < 80_000


def test_components_with_a_hub_and_a_long_chain(spark):
    hub = spark.range(1, 3000).select(F.lit(10_000).cast("long").alias("a"), (F.col("id") + 10_000).alias("b"))
    chain = spark.range(1, 500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = dict(connected_components(hub.unionByName(chain)).collect())
    assert len(got) == 3500 and {got[i] for i in range(1, 501)} == {1} and {got[10_000 + i] for i in range(3000)} == {10_000}


def test_plans_are_cut_only_where_they_cost(spark):
    scan = spark.range(10).select((F.col("id") + 1).alias("x"))
    assert settled(scan) is scan
    again = scan.groupBy("x").count()
    assert settled(again) is not again and spread(again).count() == 10


def test_ranks_of_a_hot_key(spark):
    from catalumen.runtime import split_rank

    df = third(spark, 3000, "i").na.fill({"k": -1})
    got = split_rank(df, ["k"], ["i"]).collect()
    want = {}
    for k, i in sorted((r.k, r.i) for r in got):
        want.setdefault(k, []).append(i)
    assert len(got) == 3000 and all(want[r.k][r.rank] == r.i for r in got)
    assert split_rank(df.limit(0), ["k"], ["i"]).count() == 0


def test_hot_keys_in_the_pass_of_a_cut(spark, monkeypatch):
    from catalumen import runtime

    df = third(spark, 9000, "i").groupBy("k", "i").count()
    want = hot_hashes(df, ["k"])
    out, (hot, none) = runtime.cut_hot(df, [["k"], ["i"]])
    assert hot == want and len(want) == 1 and none == [] and out.count() == 9000
    for empty in (df.limit(0), spark.createDataFrame([], "k long"), df.filter("false").join(df, "k")):
        out, (hot,) = runtime.cut_hot(empty, [["k"]])
        assert hot == [] and out.count() == 0
    # where a plan's metrics never come, a pass of its own finds the keys
    monkeypatch.setattr(runtime, "range", lambda n: [], raising=False)
    assert runtime.cut_hot(df, [["k"]])[1] == [want]
