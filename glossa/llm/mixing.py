"""Mixing sources to target weights, by blocks of words.

The words of each source, laid end to end, are packed into blocks of BLOCK words.
A source's target says how many block slots it fills; a multinomial draw deals the
slots to output shards (one pseudorandom draw a slot, then each source's counts are
scaled along the shards so that they add up to its target); slot k of a source maps
through a pseudorandom permutation of the source's block numbers, a new one each
time all blocks have been used; slots and blocks are joined by number.  Offsets come
from prefix sums in two levels, so no source is gathered in one task.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source
is one source, last in order; documents with a null doc_id take part like others;
repeated rows are separate rows; a text of any length is counted whole, and its blocks are rows of
their own; where no text has words all targets are 0; an empty table gives an empty result; columns other than doc_id, text and source pass through
`mix_documents` untouched and are ignored by `mixture`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column, cut_lineage, table, unused

BLOCK = 256
#: Rounds of the swap-or-not shuffle, and cells by which a draw finds its source.
ROUNDS, CELLS = 24, 4096
#: Slots that one task maps, about, and copies of a row that leave a task together.
SLOTS_A_TASK, PIECE = 20_000, 1000
#: Repeated rows, some 50 bytes each without text, that are broadcast.
FEW = 100_000


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Position of x in a pseudorandom permutation of 0 to n - 1: the swap-or-not shuffle.

    Each round pairs x with K - x (mod n) and one bit of the larger one's hash says whether to
    swap, so each round is a bijection for any n.
    """

    def step(acc: Column, i: Column) -> Column:
        pivot = F.pmod(F.xxhash64(i, *key), n)
        other = F.pmod(pivot - acc + n, n)
        swap = F.xxhash64(F.greatest(acc, other), i, *key).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """skey, source_size, weight and target for each source of `sizes` (skey, source, source_size).

    Water filling: where sources are sorted by cap / weight, those that reach their cap come first.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    s = sizes.select("*", F.element_at(F.array(*map(F.lit, map(float, weights))), nth + 1).alias("weight"), (F.col("source_size") * float(cap)).alias("most"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "skey")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * share
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "skey", "level"))
    s = s.withColumn("line", F.min(free).over(whole)["level"])
    target = F.when(F.col("line").isNull(), F.col("most")).otherwise(F.least("most", F.col("line") * F.col("weight")))
    return s.select("skey", "source_size", "weight", target.alias("target"))


def slot_counts(targets: DataFrame) -> DataFrame:
    """Whole passes over a source's blocks and what the last, partial pass takes, in slots."""
    want = F.least(F.round("target").cast("long"), F.floor("target") + 1)
    s = targets.withColumn("want", want).withColumn("full", F.floor(F.col("source_size") / BLOCK)).withColumn("tail", F.col("source_size") - F.col("full") * BLOCK)
    s = s.withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("long"))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0))
    s = s.withColumn("left", F.col("want") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("last", F.ceil(F.least("left", F.col("full") * BLOCK) / BLOCK)).withColumn("of_tail", F.greatest(F.lit(0), F.col("left") - F.col("full") * BLOCK))
    return s.withColumn("slots", (F.col("passes") * F.col("blocks") + F.col("last") + (F.col("of_tail") > 0).cast("long")).cast("long"))


def draw_slots(sources: DataFrame, seed: int) -> DataFrame:
    """One row for each slot of the mix: shard, skey, slot (its number within the source)."""
    spark = sources.sparkSession
    n = int(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    shards = max(1, math.isqrt(n))
    up = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = sources.where("slots > 0").select("skey", "slots", F.sum("slots").over(up).alias("hi"))
    bins = bins.select("skey", ((F.col("hi") - F.col("slots")) / max(1, n)).alias("lo"), (F.col("hi") / max(1, n)).alias("hi"))
    bins = bins.select("*", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    u = F.shiftright(F.xxhash64(F.col("id"), F.lit(seed)), 11) / float(1 << 53) + 0.5
    draws = spark.range(n).select(F.floor(F.col("id") * shards / n).alias("shard") if n else F.lit(0).cast("long").alias("shard"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = draws.join(bins, "cell").where("u >= lo AND u < hi").groupBy("shard", "skey").agg(F.count(F.lit(1)).alias("c"))
    # Scale each source's running count so that the whole is its number of slots.
    run = Window.partitionBy("skey").orderBy("shard")
    drawn = drawn.withColumn("upto", F.sum("c").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("c").over(Window.partitionBy("skey")))
    some = sources.select("skey", "slots").where("slots > 0").join(drawn, "skey", "left")
    to = F.when(F.col("all").isNull() | (F.col("upto") == F.col("all")), F.col("slots")).otherwise(F.floor(F.col("upto") * (F.col("slots") / F.col("all")))).cast("long")
    some = some.select("skey", F.coalesce("shard", F.lit(0)).alias("shard"), to.alias("to")).withColumn("from", F.coalesce(F.lag("to").over(Window.partitionBy("skey").orderBy("shard")), F.lit(0)))
    # Few rows here, many slots after: dealt over tasks first, however small they are.
    some = some.where(F.col("to") > F.col("from")).repartition(max(1, min(8192, n // SLOTS_A_TASK)), "skey", "shard")
    return some.select("shard", "skey", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("slot"))


def block_takes(sources: DataFrame, seed: int = 1) -> DataFrame:
    """shard, skey, slot, block and the leading words that the slot takes of the block."""
    full, tail = F.col("full"), F.col("tail")
    s = draw_slots(sources, seed).join(sources.drop("source_size", "weight", "target"), "skey")
    s = s.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("at", F.col("slot") - F.col("pass") * F.col("blocks"))
    ends = F.col("pass") == F.col("passes")
    words = F.when(F.col("at") == full, F.when(ends, F.col("of_tail")).otherwise(tail)).when(ends & (F.col("at") == F.col("last") - 1), F.least("left", full * BLOCK) - (F.col("last") - 1) * BLOCK).otherwise(BLOCK)
    block = F.when(F.col("at") == full, full).otherwise(permuted(F.col("at"), F.greatest(full, F.lit(1)), F.col("skey"), F.col("pass"), F.lit(seed)))
    whole = words == F.when(F.col("at") == full, tail).otherwise(BLOCK)
    return s.select("shard", "skey", "slot", block.alias("block"), words.cast("long").alias("words"), whole.alias("whole"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: int = 1) -> DataFrame:
    """doc_id, skey, th (text hash), size, source_size, target and taken for each row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.col("source").cast("string")
    n = docs.count()
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("th"),
    ).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(max(1, math.isqrt(n)))))
    rows = cut_lineage(rows)
    chunks = rows.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    sizes = chunks.groupBy("skey").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")))
    sources = cut_lineage(slot_counts(source_targets(sizes, weights, share, cap)))

    ahead = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(sources.select("skey", "source_size", "target"), "skey")
    own = Window.partitionBy("skey", "chunk").orderBy("doc_id", "th", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(chunks.drop("words"), ["skey", "chunk"])
    placed = placed.select("doc_id", "skey", "th", "size", "source_size", "target", (F.col("before") + F.col("own")).alias("start"))

    takes = block_takes(sources, seed).groupBy("skey", "block").agg(
        F.sum(F.col("whole").cast("long")).alias("times"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("part")
    )
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    pieces = placed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.lit(0), F.col("start") - F.col("block") * BLOCK)
    hi = F.least(F.lit(BLOCK), F.col("start") + F.col("size") - F.col("block") * BLOCK)
    got = F.coalesce(F.col("times") * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.col("part")) - lo), F.lit(0))
    keys = ["doc_id", "skey", "th", "size", "source_size", "target"]
    taken = pieces.join(takes, ["skey", "block"], "left").groupBy(*keys, "start").agg(F.sum(got).cast("long").alias("taken"))
    return taken.drop("start").unionByName(placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """The mix in whole documents: each row of `docs` as often as the share of its words that is taken.

    Rows alike in every column are counted together: of n of them as many come out as n times the share, a
    fraction settled by a hash of the row, so the words of each source stay near its target, also where ids are null
    or repeated, and the result does not depend on how the rows are partitioned.  Each of the n comes out equally often; what is
    left over comes from one of them, dealt to tasks PIECE rows at a time.
    """
    times = mixture(docs, seed=seed, **options).groupBy("doc_id", "skey", "th").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("ratio"))
    id_, skey, th, ratio, row, n, each, over = (unused(docs, c) for c in ("id_", "skey_", "th_", "ratio_", "row_", "n_", "each_", "over_"))
    columns = [column(c) for c in docs.columns]
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    key = {id_: F.col("doc_id"), skey: source, th: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    hashed = [F.to_json(column(c)) if kind.startswith("map") else column(c) for c, kind in docs.dtypes]
    full = F.xxhash64(*hashed, *(c.isNull() for c in columns))
    # A row for each distinct row of docs: narrow, without texts.
    rows = docs.select(*(c.alias(k) for k, c in key.items()), full.alias(row)).groupBy(id_, skey, th, row).agg(F.count(F.lit(1)).alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("skey") == F.col(skey)) & (F.col("th") == F.col(th))
    rows = rows.join(times.withColumnRenamed("doc_id", "of_id").withColumnRenamed("ratio", ratio).select(F.col("of_id").alias("doc_id"), "skey", "th", ratio), same)
    draw = F.pmod(F.xxhash64(id_, th, row, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("total", F.floor(F.col(n) * F.col(ratio) + draw)).withColumn(each, F.floor(F.col("total") / F.col(n)).cast("int"))
    rows = cut_lineage(rows.where("total > 0").select(id_, skey, th, row, each, (F.col("total") - F.col(each) * F.col(n)).alias(over)))

    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (key[skey] == F.col(skey)) & (key[th] == F.col(th)) & (full == F.col(row))
    whole = docs.join(rows.where(F.col(each) > 0), on).select(*columns, F.explode(F.sequence(F.lit(1), F.col(each))).alias(each)).select(*columns)
    left = rows.where(F.col(over) > 0)  # of rows that are repeated
    n_left = left.count()
    if not n_left:
        return whole
    left = F.broadcast(left) if n_left <= FEW else left
    ones = docs.join(left, on).groupBy(id_, skey, th, row, over).agg(F.first(F.struct(*(c.alias(x) for c, x in zip(columns, docs.columns, strict=True)))).alias(each))
    pieces = ones.select(row, each, over, F.explode(F.sequence(F.lit(0), F.floor((F.col(over) - 1) / PIECE))).alias(n))
    pieces = pieces.repartition(row, n).select(each, F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.col(over) - F.col(n) * PIECE))).alias(n))
    return whole.unionByName(pieces.select(f"{each}.*"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")).alias("source"))
