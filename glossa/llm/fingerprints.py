"""Document fingerprints by winnowing, in DataFrame operations alone.

A text's k-grams are CHARS consecutive code points, white space left out; each WINDOW
consecutive k-grams give their smallest hash, rightmost on ties, with its position.  The
distinct picks are the fingerprint: any two texts that share CHARS + WINDOW - 1 code
points in a row share a pick, whatever the script and wherever they stand.  Likeness is
the Jaccard similarity of the picked hashes.

An edited text is a beginning of one text and a beginning of the next, so its windows are
those of either beginning and the few across the seam.  The picks of a beginning are the whole
text's picks whose first window ends within it; only the seam is hashed anew.

The next document by descending doc_id is found within buckets of near equal bytes: cut
points come from a range partitioning of (id, text hash, row number) alone, where a row counts by
its bytes, so neither equal ids nor equal rows make a large bucket.  Each bucket
also gets a copy of the next bucket's first row, so texts are shuffled once and no task
holds the whole order.

Defined results: a null text is empty; an empty text has an empty fingerprint, like
another empty one to degree 1 and others 0; texts of fewer than CHARS code points
have one k-gram, of fewer than WINDOW k-grams one window; a text of any length is
fingerprinted whole (a long for each code point is held while it is); the only document is its
own successor; null ids come last, equal ids follow in order of their texts' hashes;
repeated rows follow each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: Code points of a k-gram, and k-grams of a window.
CHARS, WINDOW = 6, 8
SPAN = CHARS + WINDOW - 1
POSITION = 31  # bits
LAST = (1 << POSITION) - 1
#: K-grams that are cut from one part of a text: a cut counts code points from the part's start.
PART = 32
#: Bytes of a bucket, and of a huge table's the square root of so many bytes times its size (16 GB of text have buckets of
#: 8 MB, 100 TB some 600 MB); of a small table, the least bytes and the buckets for each core; bytes that count as one row where cuts are looked for.
BUCKET_BYTES, GROWTH, LEAST_BYTES, A_CORE, UNIT = 8 << 20, 4096, 1 << 18, 4, 1 << 12
_BLANK = r"\s+"
_ALL = 1 << 30


def picks(solid: Column) -> Column:
    """array<long> of the picked hashes of a text without white space, each packed with its position, in order."""
    parts = F.regexp_extract_all(solid, F.lit(rf"(?s)(?=(.{{1,{PART + CHARS - 1}}})).{{1,{PART}}}"), F.lit(1))

    def grams(part: Column, k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(part) - (CHARS - 1))
        return F.when(F.length(part) >= CHARS, F.transform(starts, lambda i: _packed(F.substring(part, i, F.lit(CHARS)), k * PART + i - 1))).otherwise(F.array().cast("array<bigint>"))

    many = F.flatten(F.transform(parts, grams))
    few = F.when(solid != "", F.array(_packed(solid, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.length(solid) >= CHARS, many).otherwise(few)


def _packed(gram: Column, position: Column) -> Column:
    """Upper half of a hash, then its position so that the rightmost is least."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(gram), 32), POSITION) + (F.lit(LAST).cast("long") - position)


def with_picks(df: DataFrame, solid: str, out: str) -> DataFrame:
    """df with `out`: the distinct minima of all windows of k-grams of the column `solid`."""
    n, h = "__n", "__h"
    df = df.withColumn(h, picks(F.col(solid))).withColumn(n, F.size(h))
    step = 1
    while step < WINDOW:  # minima of 2, 4, ... k-grams
        df = df.withColumn(h, F.zip_with(h, F.slice(h, step + 1, _ALL), lambda a, b: F.least(a, b)))
        step *= 2
    whole = F.greatest(F.col(n) - (WINDOW - 1), F.lit(1))
    return df.withColumn(out, F.array_distinct(F.slice(F.col(h), F.lit(1), whole))).drop(n, h)


def _at(pick: Column) -> Column:
    return F.lit(LAST).cast("long") - pick.bitwiseAND(F.lit(LAST).cast("long"))


def _within(picked: Column, length: Column) -> Column:
    """The picks of a text's first `length` code points, from those of the whole text.

    A pick's first window begins where the pick enters it at the right end, if it is less than the
    pick before, and else where the pick before leaves.
    """

    def first(x: Column, i: Column) -> Column:
        last = F.get(picked, i - 1)
        return F.when(i == 0, F.lit(0).cast("long")).when(x < last, _at(x) - (WINDOW - 1)).otherwise(_at(last) + 1)

    none = F.array().cast("array<bigint>")
    return F.when(length >= SPAN, F.filter(picked, lambda x, i: first(x, i) <= length - SPAN)).otherwise(none)


def shown(picked: Column) -> Column:
    """A fingerprint as text: hash (8 hex digits) and position of each pick."""
    one = lambda x: F.concat(F.lower(F.lpad(F.hex(F.shiftright(x, POSITION)), 8, "0")), F.lit("@"), _at(x).cast("string"))
    return F.array_join(F.transform(picked, one), " ")


def hashes(picked: Column) -> Column:
    return F.array_distinct(F.transform(picked, lambda x: F.shiftright(x, POSITION)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _bucket(cuts: list[tuple[int, int, int]]) -> Column:
    """How many cuts are at most (down, th, rid), in two steps over constant arrays."""
    if not cuts:
        return F.lit(0)
    key = F.struct("down", "th", "rid")
    array = lambda xs: F.from_json(F.lit(json.dumps([dict(zip(("down", "th", "rid"), x)) for x in xs])), "array<struct<down:bigint,th:bigint,rid:bigint>>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    fan = max(2, math.isqrt(len(cuts)))
    coarse = F.greatest(below(array(cuts[::fan])) - 1, F.lit(0)) * fan
    return (coarse + below(F.slice(array(cuts), coarse + 1, F.lit(fan)))).cast("int")


def _cuts(narrow: DataFrame) -> list[tuple[int, int, int]]:
    """Where buckets after the first begin: one for each BUCKET_BYTES, more slowly in huge tables, or so that every core has some."""
    total = narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(math.ceil(total / max(BUCKET_BYTES, math.isqrt(GROWTH * total))), min(math.ceil(total / LEAST_BYTES), A_CORE * narrow.sparkSession.sparkContext.defaultParallelism))
    if buckets < 2:
        return []
    units = narrow.select("down", "th", "rid", F.explode(F.array_repeat(F.lit(0), F.ceil(F.col("bytes") / UNIT).cast("int"))))
    ranged = units.repartitionByRange(buckets, "down", "th", "rid").withColumn("part", F.spark_partition_id())
    firsts = ranged.groupBy("part").agg(F.min(F.struct("down", "th", "rid")).alias("k")).orderBy("part").collect()
    return [tuple(r["k"]) for r in firsts[1:]]


def with_successors(docs: DataFrame) -> DataFrame:
    """doc_id, text, ghost, bucket, down, th, rid: each bucket ends with the row that follows it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", text.alias("text"), F.bitwise_not(key).alias("down"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("rid"))
    narrow = cut_lineage(rows.select("down", "th", "rid", (F.octet_length("text") + 64).cast("long").alias("bytes")))
    cuts = _cuts(narrow)
    rows = rows.withColumn("bucket", _bucket(cuts))
    heads = narrow.select("down", "th", _bucket(cuts).alias("bucket")).groupBy("bucket").agg(F.min(F.struct("down", "th")).alias("k"))
    heads = heads.select("bucket", "k.down", "k.th", F.pmod(F.col("bucket") - 1, F.lit(len(cuts) + 1)).alias("to"))  # one row for each bucket
    # Several rows with a head's id and text are alike: any of them stands for it.
    ghosts = rows.join(F.broadcast(heads), ["bucket", "down", "th"]).withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("rid"))).where("nth = 1")
    ghosts = ghosts.select("doc_id", "text", "down", "th", "rid", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    ahead = Window.partitionBy("bucket").orderBy("ghost", "down", "th", "rid")
    # Only texts are shuffled: what is made of them comes after the first window, the second one finds rows in place.
    df = with_successors(docs).withColumn("next_text", F.lead("text").over(ahead))
    df = with_picks(df.withColumn("solid", F.regexp_replace("text", _BLANK, "")), "solid", "own")
    df = df.withColumn("next_own", F.lead("own").over(ahead)).where("NOT ghost")
    df = df.withColumn("h", hashes(F.col("own"))).withColumn("next_h", hashes(F.col("next_own")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("head", F.substring("text", F.lit(1), n - half)).withColumn("tail", F.substring("next_text", F.lit(1), half))
    df = df.withColumn("edited_sha256", F.sha2(F.concat("head", "tail"), 256))
    # Both beginnings without white space: their lengths, and the text about the seam.
    df = df.withColumn("tail", F.regexp_replace("tail", _BLANK, "")).withColumn("a", F.length(F.regexp_replace("head", _BLANK, ""))).withColumn("b", F.length("tail")).drop("text", "next_text", "head")
    start = F.greatest(F.lit(0), F.col("a") - (SPAN - 1))
    seam = F.concat(F.substring("solid", start + 1, F.col("a") - start), F.substring("tail", F.lit(1), F.lit(SPAN - 1)))
    df = df.withColumn("start", start).withColumn("seam", F.when((F.length(seam) >= SPAN) | (F.col("a") + F.col("b") < SPAN), seam).otherwise(F.lit("")))
    df = with_picks(df.drop("solid", "tail"), "seam", "across")
    moved = lambda picked, by: F.transform(picked, lambda x: x - F.col(by))
    df = df.withColumn("other", F.array_distinct(F.concat(_within(F.col("own"), F.col("a")), moved(F.col("across"), "start"), moved(_within(F.col("next_own"), F.col("b")), "a"))))
    return df.withColumn("e", hashes(F.col("other"))).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"),
        likeness("h", "e").alias("near_edited"), likeness("h", "next_h").alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
