"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

One scan takes length and prefix hash of each text (a columnar file gives neither without the
text, so both come from the same read).  Lengths that several rows share survive; of their rows,
the (length, prefix hash) groups of several rows survive.  The second scan takes the full hash
of texts of surviving groups alone: a bitmap of the groups, of at most BUCKETS * 4 kB, is
broadcast and tested in the scan, so no text is shuffled and most texts of their own are never
hashed.  The bitmap only saves work: a text that passes it by chance gets a full hash that
no other has; past some 16 million groups it fills up and more texts are hashed.

The row of the largest id stays, of several such rows one.  Groups over 1/WIDE of all rows, at
most WIDE of them, are joined by broadcast, so no task gathers the rows of one text; other groups are
joined by a shuffle of ids and hashes.

Defined results: a null text is an empty one; null ids are below all others, and where a group has
no other its keep_id is null and one of its rows stays; of rows alike in id and text one stays; a text
of any length is hashed whole; an empty table gives an empty result; other columns pass
through where they are carried, but those named keep_id, group_size or kept are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut_lineage, table

#: Code points of a text's prefix.
PREFIX = 128
#: Bits of the bitmap for each surviving group, bits of one of its rows, and the most rows it has.
BITS_A_GROUP, BUCKET_BITS, BUCKETS = 16, 32768, 8192
#: Groups over 1/WIDE of all rows are joined by broadcast.
WIDE = 10_000


def surviving_groups(docs: DataFrame, text: Column) -> DataFrame:
    """n (bytes) and p (prefix hash) of the groups of several rows, refined by length first."""
    rows = docs.select(F.octet_length(text).alias("n"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("p"))
    groups = cut_lineage(rows.groupBy("n", "p").agg(F.count(F.lit(1)).alias("c")))
    lengths = groups.groupBy("n").agg(F.sum("c").alias("of_length")).where("of_length > 1")
    return groups.where("c > 1").join(lengths, "n", "left_semi").select("n", "p")


def _bitmap(groups: DataFrame, bits: int) -> DataFrame:
    """bucket, bitmap: the bits of all groups."""
    at = F.pmod(F.xxhash64("n", "p"), F.lit(bits)) + 1
    bits_of = groups.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return bits_of.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def exact_duplicates(docs: DataFrame, carry: Sequence[str] = ("doc_id",), normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """The carried columns of every row of `docs`, with keep_id, group_size and kept.

    normalise: what is done to texts before they are compared.
    """
    carry = [c for c in carry if c.lower() not in ("keep_id", "group_size", "kept")]
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    groups = surviving_groups(docs, text)
    bits = min(BUCKETS, -(-groups.count() * BITS_A_GROUP // BUCKET_BITS)) * BUCKET_BITS or BUCKET_BITS
    rows = docs.select(F.struct(*(column(c).alias(c) for c in carry)).alias("row"), F.col("doc_id").alias("id"), text.alias("t"), F.octet_length(text).alias("n"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("n", F.xxhash64(F.substring("t", 1, PREFIX))), F.lit(bits)) + 1)
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("at")).join(F.broadcast(_bitmap(groups, bits)), "bucket", "left")  # at most BUCKETS rows
    bit = F.bitmap_bit_position("at")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    rows = rows.select("row", "id", F.when(maybe, F.unhex(F.sha2("t", 256))).alias("h"))
    rows = cut_lineage(rows).withColumn("rid", F.monotonically_increasing_id())

    top = F.max(F.struct("id", "rid")).alias("top")
    same = rows.where("h IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("c"), top).where("c > 1")
    same = cut_lineage(same.select("h", "c", "top.id", "top.rid").toDF("h", "c", "keep_id", "keep_rid"))
    n_rows = rows.count()
    wide = F.broadcast(same.where(F.col("c") * WIDE > n_rows).toDF("h", "c1", "keep1", "rid1"))
    rest = same.where(F.col("c") * WIDE <= n_rows).toDF("h", "c2", "keep2", "rid2")
    rows = rows.join(wide, "h", "left")
    narrow = rows.where("h IS NOT NULL AND c1 IS NULL").join(rest, "h", "left")
    done = rows.where("h IS NULL OR c1 IS NOT NULL")
    for c in ("c2", "keep2", "rid2"):
        done = done.withColumn(c, F.lit(None).cast("long"))
    out = done.unionByName(narrow)
    alone = F.coalesce("c1", "c2").isNull()
    keep = F.when(alone, F.col("id")).when(F.col("c1").isNotNull(), F.col("keep1")).otherwise(F.col("keep2"))
    kept = alone | (F.col("rid") == F.coalesce("rid1", "rid2"))
    return out.select("row.*", keep.alias("keep_id"), F.coalesce("c1", "c2", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return exact_duplicates(docs, ("doc_id", "text_sha256")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
