"""Counts at all levels against counting each level alone."""

import itertools
import random
from collections import defaultdict

from glossa.operators.levels import level_counts


def plain(rows):
    out = {}
    for keep in itertools.product((True, False), repeat=3):
        level = int("".join("0" if k else "1" for k in keep), 2)
        n, ids = defaultdict(int), defaultdict(set)
        for *dims, ident in rows:
            key = tuple(d if k else None for d, k in zip(dims, keep, strict=True))
            n[key] += 1
            ids[key] |= {ident} - {None}
        out |= {(*key, level): (n[key], len(ids[key])) for key in n}
    return out


def test_all_levels(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", ""]), rnd.choice([1, 2, None]), rnd.choice([None, *range(20)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "lang string, source string, k int, id int").repartition(5)
    got = {tuple(r[:4]): tuple(r[4:]) for r in level_counts(df, ["lang", "source", "k"], "id").select("lang", "source", "k", "level", "n", "ids").collect()}
    assert got == plain(rows)
    assert level_counts(df.where("false"), ["lang", "source", "k"], "id").count() == 0


def test_rows_are_counted_before_they_are_expanded(spark):
    df = spark.createDataFrame([("en", "a", 1, 1)] * 50, "lang string, source string, k int, id int")
    plan = level_counts(df, ["lang", "source", "k"], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("Aggregate")


def test_levels_hold_no_row_for_each_id(spark):
    """What is held after the expansion is a row for each combination and pattern of marks, and ids at the edges of batches."""
    df = spark.range(20000).selectExpr("if(id % 2 = 0, 'en', 'de') AS lang", "'a' AS source", "id % 3 AS k", "id DIV 2 AS id")
    got = level_counts(df, ["lang", "source", "k"], "id")
    assert got.count() == 24
    plan = str(got._jdf.queryExecution().optimizedPlan())
    assert "__id" not in plan[: plan.index("Expand")]


def test_ids_over_the_edges_of_batches(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "b"]), rnd.choice([1, 2, None]), rnd.choice([None, 1, 2, *range(40)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "lang string, source string, k int, id int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for size in ("1", "3", "7"):
            spark.conf.set(key, size)
            got = level_counts(df, ["lang", "source", "k"], "id")
            assert {tuple(r[:4]): tuple(r[4:]) for r in got.select("lang", "source", "k", "level", "n", "ids").collect()} == plain(rows)
    finally:
        spark.conf.set(key, old)


def test_weights_and_repeated_rows(spark):
    rows = [("en", "a", 1, 7, 2), ("en", "a", 1, 7, 3), ("en", "b", 1, 7, 1), ("en", "a", 1, 8, 4), ("en", "a", 1, None, 5)]
    got = level_counts(spark.createDataFrame(rows, "lang string, source string, k int, id int, w long"), ["lang", "source", "k"], "id", weight="w")
    want = plain([tuple(r[:4]) for r in rows for _ in range(r[4])])
    assert {tuple(r[:4]): tuple(r[4:]) for r in got.select("lang", "source", "k", "level", "n", "ids").collect()} == want


def test_dimensions_of_other_types(spark):
    df = spark.sql("SELECT struct(id % 2 AS a, if(id % 3 = 0, NULL, 'x') AS b) AS s, if(id % 2 = 0, double('NaN'), -0.0d) AS d, named_struct('i', id DIV 4) AS id FROM range(60)")
    got = {(r.level): (r.n, r.ids) for r in level_counts(df, ["s", "d"], "id").where("level = 3 OR (level = 2 AND isnan(d))").collect()}
    assert got == {3: (60, 15), 2: (30, 15)}
    df = spark.sql("SELECT d, 1 AS id, 2L AS w FROM VALUES (0.0d), (-0.0d) AS t(d)")
    assert sorted(tuple(r) for r in level_counts(df, ["d"], "id", weight="w").select("level", "n", "ids").collect()) == [(0, 4, 1), (1, 4, 1)]
    assert [tuple(r) for r in level_counts(df, [], "id").collect()] == [(0, 2, 1)]
