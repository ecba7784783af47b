"""Interval join of two tables: pairs of rows of equal keys whose half-open intervals overlap.

Intervals go to bins of a fixed width, so the join is one of equal keys and bins.  An interval that
covers more than two bins belongs to a wider level, where it covers at most two; one of a lower level looks for it
at the levels that the other side uses, of which there are at most LEVELS.  So no interval goes to more than
2 * LEVELS bins however long it is.  Of the bins a pair shares, the one of the later start at the wider of
the two levels reports it, once.

A bin with many rows, of one key or because many intervals lie at one place, is split: its left rows are dealt
to pieces, its right rows to pieces, and each piece of one side meets each of the other, so no task has
more than about BIN_ROWS of either side from it.

Two intervals overlap where each starts before the other ends: touching is not overlap, and an empty interval
overlaps what it lies strictly inside of.  Rows with a null key, start or end have no pairs; nor have intervals that
end before they start.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checkpointed

#: Levels, each FACTOR times as wide as the one below: intervals of any length that a long can hold have one.
LEVELS, FACTOR = 21, 8
#: Rows of a bin that stay together, and split bins that are broadcast.
BIN_ROWS, BROADCAST_BINS = 20_000, 100_000


def _bin(at: Column, width: int, level: int) -> Column:
    """Floor of at / (width * FACTOR^level), both powers of two."""
    return F.shiftright(at, min(63, (width.bit_length() - 1) + (FACTOR.bit_length() - 1) * level))


def _last(start: Column, end: Column) -> Column:
    """The last position of an interval, its start where it is empty."""
    return F.when(end > start, end - 1).otherwise(start)


def _level(start: Column, end: Column, width: int) -> Column:
    """The lowest level at which the interval covers at most two bins."""
    out = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(_bin(_last(start, end), width, level) <= _bin(start, width, level) + 1, level).otherwise(out)
    return out


def _placed(df: DataFrame, on: Sequence[str], start: str, end: str, width: int, side: str) -> DataFrame:
    """Keys k0.., start, end, level and the row of one side, rows that can have pairs only."""
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)]
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias(side)
    out = df.select(*keys, F.col(f"`{start}`").cast("long").alias(f"{side}_start"), F.col(f"`{end}`").cast("long").alias(f"{side}_end"), row)
    out = out.where(f"{side}_start <= {side}_end").dropna(subset=[f"k{i}" for i in range(len(on))] or None)
    return out.withColumn(f"{side}_level", _level(F.col(f"{side}_start"), F.col(f"{side}_end"), width))


def _entry(level: int, b: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), b.alias("bin"))


def _binned(df: DataFrame, side: str, used: set[int], others: set[int], width: int) -> DataFrame:
    """A row for each level and bin at which a row of this side may meet one of the other."""
    start, end, own = F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"{side}_level")
    entries = [F.array().cast("array<struct<level:int,bin:bigint>>")]
    for level in sorted(used | others):
        here = own <= level if level in others else own == level
        bins = F.when(here, F.sequence(_bin(start, width, level), _bin(_last(start, end), width, level))).otherwise(F.array().cast("array<bigint>"))
        entries.append(F.transform(bins, partial(_entry, level)))
    return df.withColumn("at", F.explode(F.flatten(F.array(*entries)))).select("*", "at.level", "at.bin").drop("at")


def _split(df: DataFrame, by: list[str], side: str, hot: DataFrame) -> DataFrame:
    """Rows of hot bins dealt to their pieces and copied for those of the other side; (0, 0) for all others."""
    other = "right" if side == "left" else "left"
    joined = df.join(hot, by, "left")
    mine = F.pmod(F.xxhash64(side), F.coalesce(f"{side}_pieces", F.lit(1))).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_pieces", F.lit(1)) - 1))
    joined = joined.withColumn(f"{side}_piece", mine).withColumn(f"{other}_piece", theirs)
    return joined.drop("left_pieces", "right_pieces")


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), width: int = 64) -> DataFrame:
    """left and right: the rows of each pair, as structs.

    on: columns of both sides that must be equal; width: of a bin at the lowest level, about the
    length of the shorter intervals, made a power of two.
    """
    width = 1 << max(1, (width - 1).bit_length())
    a, b = checkpointed(_placed(left, on, *left_span, width, "left")), checkpointed(_placed(right, on, *right_span, width, "right"))
    used = [{r[0] for r in df.select(f"{side}_level").distinct().collect()} for df, side in ((a, "left"), (b, "right"))]  # at most LEVELS each
    a, b = _binned(a, "left", *used, width), _binned(b, "right", *used[::-1], width)
    by = [f"k{i}" for i in range(len(on))] + ["level", "bin"]
    many = lambda df, side: df.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BIN_ROWS).select(*by, F.ceil(F.col("c") / BIN_ROWS).cast("int").alias(f"{side}_pieces"))
    hot = checkpointed(many(a, "left").join(many(b, "right"), by, "full").select(*by, *(F.coalesce(f"{s}_pieces", F.lit(1)).alias(f"{s}_pieces") for s in ("left", "right"))))
    hot_bins = hot.limit(BROADCAST_BINS + 1).count()
    if hot_bins:
        few = F.broadcast(hot) if hot_bins <= BROADCAST_BINS else hot
        a, b, by = _split(a, by, "left", few), _split(b, by, "right", few), [*by, "left_piece", "right_piece"]
    pairs = a.join(b, by)
    later = F.greatest("left_start", "right_start")
    home = F.lit(None).cast("long")
    for level in sorted(used[0] | used[1]):
        home = F.when(F.col("level") == level, _bin(later, width, level)).otherwise(home)
    overlap = (F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end"))
    once = (F.col("level") == F.greatest("left_level", "right_level")) & (F.col("bin") == home)
    return pairs.where(overlap & once).select("left", "right")
