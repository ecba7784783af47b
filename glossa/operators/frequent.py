"""The k most frequent items of each group, with exact counts.

First a sketch of at most TRACKED counters for each group is built in each task and merged: no item of more than
a known share of its group is missing from it.  Then the sketched items alone are counted exactly, in the tasks
that read the rows first.  Where the k-th of a group has more rows than any item can have that the
sketch missed, its items are the true ones; a group where this cannot be told (many items about as frequent
as each other) is counted whole.  Only few counts of each group are ever ranked, never its rows.

Defined results: items are ranked by count and then by their own order; null items are not counted; a null group is
a group like others; a group with fewer than k items has all of them; k beyond TRACKED counts every group whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed

#: Counters of a group's sketch, and items whose names are broadcast.
TRACKED, BROADCAST_ITEMS = 1024, 200_000


def _missed(tracked: int) -> float:
    """The share of its group's rows that an item may have and yet be missing.

    A counter is off by at most 3.5 over the sketch's size, a power of two that is three quarters full, and
    items are given whose count less that exceeds it.
    """
    return 7.0 / (1 << math.ceil(math.log2(tracked / 0.75)))


def _within(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are among those of `some`, null groups too."""
    n = some.limit(BROADCAST_ITEMS + 1).count()
    some = some.select(*(F.col(c).alias(f"of_{c}") for c in on))  # names of their own, as both come from the same rows
    return rows.join(F.broadcast(some) if n <= BROADCAST_ITEMS else some, _alike(on), "left_semi")


def _alike(on: list[str]) -> Column:
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return same


def top_items(rows: DataFrame, by: Sequence[str], item: str, k: int, tracked: int = TRACKED) -> DataFrame:
    """by..., item, n (rows of the item in the group) and rank (from 1)."""
    by = list(by)
    rows = rows.select(*by, item).where(F.col(item).isNotNull())
    ranked = Window.partitionBy(*by).orderBy(F.desc("n"), item)

    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))

    def best(counts: DataFrame) -> DataFrame:
        return counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    if k > tracked:
        return best(counted(rows))
    sketch = F.call_function("approx_top_k", item, F.lit(tracked), F.lit(tracked))
    groups = checkpointed(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("all"), F.transform(sketch, lambda x: x["item"]).alias("items")))
    found = groups.select(*by, F.explode("items").alias(item))
    counts = checkpointed(counted(_within(rows, found, [*by, item])))
    # What is counted is the whole group, or its k-th item is beyond all that may be missing.
    of = counts.groupBy(*(F.col(c).alias(f"of_{c}") for c in by)).agg(F.sum("n").alias("seen"), F.try_element_at(F.sort_array(F.collect_list("n"), asc=False), F.lit(k)).alias("kth"))  # at most `tracked` counts
    sure = (F.coalesce("seen", F.lit(0)) == F.col("all")) | F.coalesce(F.col("kth") > F.col("all") * _missed(tracked), F.lit(False))
    told = checkpointed(groups.drop("items").join(of, _alike(by), "left").select(*by, sure.alias("sure")))
    open_ = told.where("NOT sure").select(*by)
    done = best(_within(counts, told.where("sure").select(*by), by))
    if open_.isEmpty():
        return done
    return done.unionByName(best(counted(_within(rows, open_, by))))
