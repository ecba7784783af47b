"""As-of join: each left row with the last right row of its key at or before its time.

Both sides are put together and range-sorted by key and time, so a key with most of the rows lies in many
ranges.  Within a range a running last value carries right rows forward; over the edges only the first key
of a range can need what came before it, so a second level carries, for these keys alone (one for each range),
the last right row of earlier ranges.

Defined results: every left row comes out once.  Without a predecessor, or where its key or time is null, its
right columns are null; right rows with a null key or time are nobody's predecessor.  Right rows at the very time
count unless exact is False.  Of right rows of one key and time the greatest by `tie` is
taken, then by all its columns.  With a tolerance, a predecessor further back than that is none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed

#: Rows of a range, about.
RANGE_ROWS = 100_000


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, tie: Sequence[str] = (), exact: bool = True, tolerance: int | Column | None = None) -> DataFrame:
    """left and right: each left row and the right row as of its time, as structs (right null where there is none).

    tolerance: what right_time plus it may not fall short of left_time by: a number, or an interval for timestamps.
    """
    if left.schema[left_time].dataType != right.schema[right_time].dataType:
        raise ValueError("times of both sides must be of one type")
    keys = [f"k{i}" for i in range(len(on))]
    spark = left.sparkSession

    def side(df: DataFrame, time: str, name: str, place: int) -> DataFrame:
        row = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))
        order = F.struct(*(F.col(f"`{c}`") for c in (*tie, *df.columns))) if name == "right" else None
        cols = [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]
        return df.select(*cols, F.col(f"`{time}`").alias("t"), F.lit(place).alias("side"), row.alias(name), *([order.alias("tie")] if name == "right" else []))

    a, b = side(left, left_time, "left", 1 if exact else 0), side(right, right_time, "right", 0 if exact else 1)
    known = F.lit(True)
    for c in (*keys, "t"):
        known = known & F.col(c).isNotNull()
    alone = a.where(~known).select("left", F.lit(None).cast(b.schema["right"].dataType).alias("right"))
    # Counted, sampled for the ranges and dealt to them: worked out once.
    both = checkpointed(a.where(known).unionByName(b.where(known), allowMissingColumns=True))
    order = ["t", "side", "tie"]
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(both.count() / RANGE_ROWS))
    # What is drawn from the ranges below must be cut alike: written once.
    ranged = checkpointed(both.repartitionByRange(ranges, *keys, *order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("found", F.last("right", ignorenulls=True).over(within)).where("left IS NOT NULL")

    firsts = ranged.groupBy("range").agg(F.min(F.struct(*keys)).alias("k")).select("range", "k.*")  # a row for each range
    lasts = ranged.where("right IS NOT NULL").join(F.broadcast(firsts.select(*keys).distinct()), keys, "left_semi")
    lasts = lasts.groupBy("range", *keys).agg(F.max_by("right", F.struct(*order)).alias("last"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = firsts.join(lasts, ["range", *keys], "full").withColumn("carried", F.last("last", ignorenulls=True).over(before))
    edges = edges.where("carried IS NOT NULL").select("range", *keys, "carried")
    joined = placed.join(F.broadcast(edges), ["range", *keys], "left")  # at most two rows for each range
    found = F.coalesce("found", "carried")
    if tolerance is not None:
        at = found[right_time]
        found = F.when(at + tolerance >= F.col("t"), found)
    return joined.select("left", found.alias("right")).unionByName(alone)
