"""What is worked out for each occurrence is worked out once."""

from pyspark.sql import functions as F

from glossa.functions.context import window_at
from glossa.operators.review import prompt


def test_a_window_is_searched_once(spark):
    df = spark.sql("SELECT 3L AS o, 9L AS n, array(2L, 5L) AS cuts, '\\na\\nb\\n\\n' AS s")
    got = df.select(window_at(F.col("o"), F.col("n"), F.col("cuts")).alias("w"))
    assert got._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert tuple(got.first()["w"]) == (2, 5)
    shown = df.select(prompt(F.col("s"), F.lit(1), F.lit(2), F.array(F.lit("c"))).alias("p"))
    assert "regexp" not in shown._jdf.queryExecution().analyzed().toString()
    assert shown.first()["p"].startswith("\na\nb\n ^\n  0) ")
