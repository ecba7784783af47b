"""Interval join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import intervals
from glossa.operators.intervals import interval_join

KIND = "k string, s long, e long, n int"


def plain(a, b):
    return sorted(((x, y) for x in a for y in b if None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] < y[2] and y[1] < x[2]), key=repr)


def joined(spark, a, b, **options):
    left, right = spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND)
    got = interval_join(left, right, ["k"], ("s", "e"), ("s", "e"), **options)
    return sorted(((tuple(r["left"]), tuple(r["right"])) for r in got.collect()), key=repr)


def some(rnd, n, far, lengths):
    out = []
    for i in range(n):
        s = rnd.randint(-far, far)
        out.append((rnd.choice("aab"), s, s + rnd.choice(lengths), i))
    return out


@pytest.mark.parametrize(("far", "lengths", "width"), [(60, (0, 1, 3, 9), 4), (3000, (0, 1, 50, 700, 5000), 8), (1 << 40, (1, 1 << 10, 1 << 30, 1 << 41), 64), (20, (1, 2), 1)])
def test_random_intervals(spark, far, lengths, width):
    rnd = random.Random(far)
    a, b = some(rnd, 120, far, lengths), some(rnd, 120, far, lengths)
    assert joined(spark, a, b, width=width) == plain(a, b) != []


def test_edges_nulls_and_repeated_rows(spark):
    top = (1 << 63) - 1
    a = [("a", 0, 10, 1), ("a", 0, 10, 1), ("a", 5, 5, 2), ("a", 10, 20, 3), (None, 0, 9, 4), ("a", None, 9, 5), ("a", 3, None, 6), ("a", 9, 2, 7), ("a", -(1 << 63), top, 8), ("z", 0, 1, 9), ("a", -(1 << 63), -(1 << 63), 10)]
    b = [("a", 9, 11, 1), ("a", 10, 10, 2), ("a", 0, 0, 3), ("a", 5, 6, 4), (None, 0, 9, 5), ("a", 4, 7, 6), ("a", top - 1, top, 7), ("b", 0, 1, 8), ("a", 4, 7, 6)]
    assert joined(spark, a, b) == plain(a, b)
    assert joined(spark, a, []) == joined(spark, [], b) == []


def test_names_of_both_sides_may_clash(spark):
    left = spark.createDataFrame([(1, 0, 5, "x", 7)], "id int, start long, end long, level string, bin int")
    right = spark.createDataFrame([(1, 3, 9, "y", 8)], "id int, start long, end long, k0 string, left int")
    assert [tuple(map(tuple, r)) for r in interval_join(left, right, ["id"]).collect()] == [((1, 0, 5, "x", 7), (1, 3, 9, "y", 8))]


@pytest.mark.parametrize("broadcast_bins", [100_000, 0])
def test_a_bin_of_many_rows_is_split(spark, monkeypatch, broadcast_bins):
    monkeypatch.setattr(intervals, "BIN_ROWS", 25)
    monkeypatch.setattr(intervals, "BROADCAST_BINS", broadcast_bins)
    a = [("a", i % 3, 4 + i % 2, i) for i in range(160)] + [("b", i * 9, i * 9 + 4, i) for i in range(30)]
    b = [("a", 2 + i % 5, 3 + i % 5, i) for i in range(90)] + [("b", i * 7, i * 7 + 3, i) for i in range(40)]
    assert joined(spark, a, b, width=64) == plain(a, b)


def test_plan_and_level_tasks(spark):
    """No cartesian product or nested loop; with 90 % of rows in one key no task of the join has more than a few times its share."""
    n = 40_000
    key = F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
    left = spark.range(n).select(key.alias("k"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + F.col("id") % 7).alias("end"))
    right = spark.range(n).select(key.alias("k"), (F.col("id") * 5 + 2).alias("start"), (F.col("id") * 5 + F.col("id") % 11).alias("end"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = interval_join(left, right, ["k"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
        counts = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(counts) == 16 and counts[-1] < 1.5 * sum(counts) / 16
