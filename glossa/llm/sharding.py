"""Sharding along a Hilbert curve over document metadata.

Every document gets a cell (language, source and size, each quantised to 16 steps; equal
texts share the least of their cells); cells are visited in the order of a three-dimensional
Hilbert curve, and the run of documents is cut into shards of near equal bytes.  Steps follow the
order of names and sizes and hold near equal bytes (a frequent name has a step of its own), so a shard
is a compact region of the cube and the smallest and largest language, source and size of its files tell it from others.  The run is sorted once, by
ranges that also cut within a cell, a text and its copies, so no key decides how much one task
has; sums along it take two levels, ranges and rows within a range.

Groups of equal texts go to one shard.  The few groups that are large against a shard (over
1/HEAVY of all bytes or rows, so at most 2 * HEAVY) are dealt to the least loaded
shards first and the runs fill what is left; a group larger than a shard is cut into
pieces by row number, whatever its ids.  Within its shard every row stands in
curve order.

Defined results: a null text has size 1 and crc32 0; null or empty source and
language are ordinary values of their dimension; null and repeated ids are ordinary
rows; repeated rows are separate rows of one group; a text of any length is one row and is read
only for its size and hashes; an empty table gives an empty result; columns other
than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

BITS, DIMS = 4, 3
CELLS = 1 << (BITS * DIMS)
#: A group over 1/HEAVY of all bytes or rows is placed on its own; at most 2 * HEAVY are.
HEAVY = 512
#: Groups over 1/WIDE of all rows, at most WIDE of them, are broadcast (some 50 bytes each).
WIDE = 1 << 16
#: Names that are counted one by one for the steps.
NAMES = 100_000
#: Rows of a range, and pieces of a shard's size that a group larger than a shard is cut into.
RANGE_ROWS, PIECES = 50_000, 64


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Distance along the Hilbert curve: Gray-code walk, one bit of each axis a step."""
    n, x = len(point), list(point)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            if x[i] >> b & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for b in range(bits - 1, 0, -1):
        if x[n - 1] >> b & 1:
            turn ^= (1 << b) - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ turn) >> b & 1)
    return out


def curve_of(cell: Column) -> Column:
    """Curve position of a packed cell, from a constant array of all cells."""
    mask = (1 << BITS) - 1
    order = ",".join(str(hilbert_index(tuple(c >> BITS * (DIMS - 1 - d) & mask for d in range(DIMS)), BITS)) for c in range(CELLS))
    return F.element_at(F.split(F.lit(order), ",").cast("array<int>"), cell + 1)


def _steps(names: DataFrame) -> list[tuple]:
    """(value, step) for the first value of each step, for (v, c) rows of values and their bytes.

    A value's step is the share of bytes below it, in sixteenths.  Values are counted whole; where they are more
    than NAMES, by as many of their leading characters as leave few enough.
    """
    text = dict(names.dtypes)["v"] == "string"
    some = names
    for length in (16, 12, 8, 7, 6, 5, 4, 3, 2, 1) if text else ():
        if some.limit(NAMES + 1).count() <= NAMES:
            break
        some = names.groupBy(F.substring("v", 1, length).alias("v")).agg(F.sum("c").alias("c"))
    rows = some.where("v IS NOT NULL").collect()  # at most NAMES, or as many as there are characters
    total, before, steps = names.agg(F.sum("c")).first()[0], 0, []
    before = (total or 0) - sum(r["c"] for r in rows)  # nulls are below all
    for r in sorted(rows, key=lambda r: r["v"].encode() if text else r["v"]):
        step = (before << BITS) // total
        if step > (steps[-1][1] if steps else 0):
            steps.append((r["v"], step))
        before += r["c"]
    return steps


def _step(c: Column, steps: list[tuple]) -> Column:
    if not steps:
        return F.lit(0)
    at = F.size(F.filter(F.array(*(F.lit(v) for v, _ in steps)), lambda x: x <= c))
    of = F.array(F.lit(0), *(F.lit(n) for _, n in steps))
    return F.when(c.isNull(), F.lit(0)).otherwise(F.element_at(of, at + 1))


def _cells(rows: DataFrame) -> DataFrame:
    """Adds `cell`, the packed steps of lang, source and the size's logarithm (248 values)."""
    rows = rows.withColumn("log", F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int"))
    steps = [_step(F.col(c), _steps(rows.groupBy(F.col(c).alias("v")).agg(F.sum("size").alias("c")))) for c in ("lang", "source", "log")]
    cell = F.lit(0)
    for step in steps:
        cell = cell * (1 << BITS) + step
    return rows.withColumn("cell", cell.cast("int")).drop("log", "lang", "source")


_GROUP = ("th", "text_crc32", "size")
_ORDER = ("curve", *_GROUP, "rid")


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small constant table; columns: names and types as in a schema string."""
    named = [c.split() for c in columns.split(",")]
    df = spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows or [(0,) * len(named)]) + f" AS t({', '.join(n for n, _ in named)})")
    return df.where(F.lit(bool(rows))).select(*(F.col(n).cast(t).alias(n) for n, t in named))


def _placed(heavy: list, share: float, n_shards: int) -> tuple[list[tuple], list[float]]:
    """(th, text_crc32, size, pieces, piece, shard) of the heavy groups, largest first, and the bytes of each shard."""
    load, rows = [0.0] * n_shards, []
    for g in heavy:
        pieces = min(g["n"], math.ceil(g["bytes"] * PIECES / share)) if g["bytes"] > share else 1
        for piece in range(pieces):
            s = min(range(n_shards), key=lambda i: (load[i], i))
            load[s] += g["bytes"] / pieces
            rows.append((g["th"], g["text_crc32"], g["size"], pieces, piece, s))
    return rows, load


def _cuts(ordered: DataFrame, room: list[float], rest: float) -> list[tuple[int, ...]]:
    """First (curve, th, text_crc32, size) of the light groups of the second shard and on."""
    light = ordered.where("NOT heavy")
    parts = light.groupBy("part").agg(F.sum("size").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select("part", "b", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("before"))
    scale, goal, goals = rest / (sum(room) or 1), 0.0, []
    for r in room[:-1]:
        goal += r * scale
        goals.append(goal)
    wanted = F.array(*map(F.lit, goals))
    inside = F.filter(wanted, lambda t: (t >= F.col("before")) & (t < F.col("before") + F.col("b")))
    hit = {r["part"]: r for r in parts.withColumn("goals", inside).where(F.size("goals") > 0).collect()}  # at most one range for each cut
    if not hit:
        return []
    near = light.where(F.col("part").isin(*hit)).groupBy("part", "curve", *_GROUP).agg(F.sum("size").alias("b"))
    along = Window.partitionBy("part").orderBy("curve", *_GROUP)
    near = near.withColumn("own", F.sum("b").over(along) - F.col("b")).withColumn("next", F.lead(F.struct("curve", *_GROUP)).over(along))
    found = near.join(F.broadcast(parts.where(F.col("part").isin(*hit)).select("part", "before")), "part").withColumn("at", F.col("before") + F.col("own"))
    found = found.select("*", F.explode(F.filter(wanted, lambda t: (t >= F.col("at")) & (t < F.col("at") + F.col("b")))).alias("goal"))
    # A cut within a group goes to the nearer end of it.
    up = (F.col("goal") - F.col("at") > F.col("b") / 2) & F.col("next").isNotNull()
    rows = found.select("goal", F.when(up, F.col("next")).otherwise(F.struct("curve", *_GROUP)).alias("k")).orderBy("goal").collect()
    return [tuple(r["k"]) for r in rows]


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard, curve."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("th"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    rows = _cells(cut_lineage(rows)).withColumn("rid", F.monotonically_increasing_id())
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1, n_bytes / n_shards)

    groups = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("least")).where("n > 1")
    groups = cut_lineage(groups.withColumn("bytes", F.col("n") * F.col("size")))
    is_heavy = (F.col("bytes") > n_bytes / HEAVY) | (F.col("n") > n_rows / HEAVY)
    placed, load = _placed(groups.where(is_heavy).orderBy(F.desc("bytes"), *_GROUP).collect(), share, n_shards)  # at most 2 * HEAVY rows
    wide = F.col("n") * WIDE > n_rows
    one = groups.select(*_GROUP, "n", F.col("least").alias("cell1"), is_heavy.alias("h1"), wide.alias("wide"))
    rows = rows.join(F.broadcast(one.where("wide").drop("wide")), list(_GROUP), "left")
    rest = one.where("NOT wide").select(*_GROUP, F.col("cell1").alias("cell2"))
    rows = rows.join(rest, list(_GROUP), "left").select("doc_id", "rid", *_GROUP, "n", F.coalesce("h1", F.lit(False)).alias("heavy"), curve_of(F.coalesce("cell1", "cell2", "cell")).alias("curve"))

    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(n_rows / RANGE_ROWS))
    ordered = cut_lineage(cut_lineage(rows).repartitionByRange(ranges, *_ORDER)).withColumn("part", F.spark_partition_id())
    key = F.struct("curve", *_GROUP)
    shard: Column = F.lit(0)
    for c in _cuts(ordered, [max(0.0, share - x) for x in load], n_bytes - sum(load)):
        shard = shard + (key >= F.struct(*(F.lit(v).cast(t).alias(k) for v, t, k in zip(c, ("int", "bigint", "bigint", "bigint"), ("curve", *_GROUP))))).cast("int")
    light = ordered.where("NOT heavy").withColumn("shard", shard)

    # Heavy groups: each row's number in its group, from counts by range, picks a piece.
    hot = ordered.where("heavy")
    by = ["part", *_GROUP]
    upto = Window.partitionBy(*_GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = hot.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).select(*by, F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("first"))
    whole = _values(spark, sorted({p[:4] for p in placed}), "th bigint, text_crc32 bigint, size bigint, pieces int")
    pieces = _values(spark, placed, "th bigint, text_crc32 bigint, size bigint, pieces int, piece int, shard int").drop("pieces")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("rid")) - 1
    hot = hot.withColumn("nth", nth).join(firsts, by).join(F.broadcast(whole), list(_GROUP))
    hot = hot.withColumn("piece", F.floor((F.col("first") + F.col("nth")) * F.col("pieces") / F.col("n")).cast("int")).join(F.broadcast(pieces), [*_GROUP, "piece"])
    every = light.select("doc_id", "part", *_ORDER, "shard").unionByName(hot.select("doc_id", "part", *_ORDER, "shard"))

    # Slots: rows counted along the order within each shard.
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = every.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("c")).select("part", "shard", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*_ORDER)) - 1
    return every.withColumn("nth", nth).join(counts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("int").alias("curve"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
