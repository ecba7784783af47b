"""Most frequent items against counting everything."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.operators import frequent
from glossa.operators.frequent import top_items


def plain(rows, k):
    groups = defaultdict(Counter)
    for g, h, x in rows:
        if x is not None:
            groups[g, h][x] += 1
    return sorted(((g, h, x, n, i + 1) for (g, h), c in groups.items() for i, (x, n) in enumerate(sorted(c.items(), key=lambda p: (-p[1], p[0].encode()))[:k])), key=repr)


def found(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "g string, h int, x string").repartition(5)
    return sorted(map(tuple, top_items(df, ["g", "h"], "x", k, **options).collect()), key=repr)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_skewed_and_level_groups(spark, monkeypatch, broadcast):
    """A few frequent items among many rare ones, all items alike (counted whole), few items, nulls and ties."""
    monkeypatch.setattr(frequent, "BROADCAST_ITEMS", broadcast)
    rnd = random.Random(4)
    rows = [("skewed", 1, f"w{int(rnd.paretovariate(0.7))}") for _ in range(4000)]
    rows += [("level", 1, f"x{i % 700}") for i in range(2100)] + [("few", 2, "é"), ("few", 2, "z"), ("few", 2, "z"), ("few", None, "a")]
    rows += [(None, 1, x) for x in "abcab"] + [("nulls", 3, None)] * 5 + [("ties", 4, x) for x in "edcba" * 3]
    for k in (1, 3, 10):
        assert found(spark, rows, k, tracked=16) == plain(rows, k)
    assert found(spark, rows, 20, tracked=16) == plain(rows, 20)
    assert found(spark, [], 3) == []


def test_what_the_sketch_may_miss(spark):
    """No item of more than the stated share is missing from a sketch, whatever the order of the rows."""
    rnd = random.Random(9)
    tracked, n = 32, 30_000
    share = frequent._missed(tracked)
    often = [f"o{i}" for i in range(int(0.9 / share) // 2)]
    items = [x for x in often for _ in range(int(share * n) + 2)]
    items += [f"r{i}" for i in range(n - len(items))]
    rnd.shuffle(items)
    df = spark.createDataFrame([(x,) for x in items], "x string").repartition(7)
    got = df.agg(F.call_function("approx_top_k", "x", F.lit(tracked), F.lit(tracked)).alias("t")).first()["t"]
    assert set(often) <= {r["item"] for r in got}


def test_plan_ranks_counts_only(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("w"), F.least(F.col("id") % 97, F.col("id") % 7)).alias("x"))
    plan = top_items(df, ["g"], "x", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert "WindowGroupLimit" in plan
