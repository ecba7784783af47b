"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, tasks_for


#: Edges that one task handles; rounds over few edges run as few tasks.
EDGES_A_TASK = 20_000


def _star(edges: DataFrame) -> DataFrame:
    """Each u of (u, v) with the least of its neighbours and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of `edges` (a, b); label is the least node of its component.

    Every step only joins edges with one row for each node, so a hub is a skewed join
    that can be split, never a group; lineage is cut after each round.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    tasks = tasks_for(now, EDGES_A_TASK)
    now, seen = now.coalesce(tasks), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        starred = _star(large).coalesce(tasks)
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.coalesce(tasks).where("u <> v").distinct().coalesce(tasks))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
