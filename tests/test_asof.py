"""As-of join against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import asof
from glossa.operators.asof import asof_join

LEFT, RIGHT = "k string, t long, n int, right string", "k string, t long, v int, seq int"


def plain(a, b, exact=True, tolerance=None):
    out = []
    for x in a:
        fits = [y for y in b if None not in (x[0], x[1], y[0], y[1]) and y[0] == x[0] and (y[1] <= x[1] if exact else y[1] < x[1])]
        low = (float("-inf"),)
        best = max(fits, key=lambda y: (y[1], low if y[3] is None else (y[3],), tuple(low if v is None else (v,) for v in y[1:]))) if fits else None
        out.append((x, None if best is None or tolerance is not None and best[1] + tolerance < x[1] else best))
    return sorted(out, key=repr)


def joined(spark, a, b, **options):
    got = asof_join(spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT), ["k"], "t", "t", tie=["seq"], **options)
    return sorted(((tuple(r["left"]), r["right"] and tuple(r["right"])) for r in got.collect()), key=repr)


@pytest.mark.parametrize("rows", [100_000, 7])
@pytest.mark.parametrize("options", [{}, {"exact": False}, {"tolerance": 4}])
def test_random_rows(spark, monkeypatch, rows, options):
    monkeypatch.setattr(asof, "RANGE_ROWS", rows)
    rnd = random.Random(rows)
    key = lambda: rnd.choice(["hot"] * 20 + ["a", "b", None])
    time = lambda: rnd.choice([None, *range(40)])
    a = [(key(), time(), i % 50, "x") for i in range(220)]
    b = [(key(), time(), i, rnd.choice([None, 1, 2])) for i in range(60)]
    assert joined(spark, a, b, **options) == plain(a, b, **options)


def test_carried_over_many_ranges(spark, monkeypatch):
    """One right row before all, in a range of its own; others of another key between."""
    monkeypatch.setattr(asof, "RANGE_ROWS", 5)
    a = [("hot", 10 + i, i, "") for i in range(100)] + [("a", 5, 0, ""), ("z", 5, 0, "")]
    b = [("hot", 1, 1, 0), ("gap", 3, 2, 0), ("z", 6, 3, 0)]
    assert joined(spark, a, b) == plain(a, b)
    assert joined(spark, a, []) == plain(a, []) and joined(spark, [], b) == []


def test_times_of_other_types_and_two_keys(spark):
    left = spark.sql("SELECT 1 AS a, 'x' AS b, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS at UNION ALL SELECT 1, 'y', TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    right = spark.sql("SELECT 1 AS a, 'x' AS c, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS since")
    with pytest.raises(ValueError, match="one type"):
        asof_join(left, right.withColumn("since", F.lit(3)), ["a"], "at", "since")
    right = right.withColumnRenamed("c", "b")
    got = {r["left"]["b"]: r["right"] for r in asof_join(left, right, ["a", "b"], "at", "since").collect()}
    assert got["x"]["b"] == "x" and got["y"] is None
    short = asof_join(left, right, ["a", "b"], "at", "since", tolerance=F.expr("INTERVAL 3 HOURS"))
    assert [r["right"] for r in short.collect()] == [None, None]


def test_a_hot_key_is_no_one_task(spark, monkeypatch):
    monkeypatch.setattr(asof, "RANGE_ROWS", 2000)
    left = spark.range(30_000).select(F.when(F.col("id") % 20 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"))
    right = spark.range(300).select(F.lit("hot").alias("k"), (F.col("id") * 100).alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = asof_join(left, right, ["k"], "t", "t")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan and "Python" not in plan
        counts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.where("left.k = 'hot' AND right.t <> left.t - left.t % 100").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(counts) < 0.3 * 30_000


def test_sides_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def at(x):
        seen.add(1)
        return x

    left = spark.range(50).select(F.lit(1).alias("k"), F.udf(at, "long")("id").alias("t"))
    assert asof_join(left, spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("t")), ["k"], "t", "t").count() == 50
    assert seen.value <= 150  # the rows of known times, and those without, each by a filter
