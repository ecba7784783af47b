"""Benchmark decontamination by winnowing.

The k-grams of K words are hashed; of each WINDOW consecutive words the smallest hash
(rightmost on ties) is picked, and the distinct picks with their positions are a text's fingerprint.
Documents' picks pass a bitmap of fixed size and are joined with the distinct picks
of the benchmark; each hit is then extended on the words around it: the windows of WINDOW
words that hold the pick are looked up among those around the benchmark's picks.  A
window that a document and an item share has the same pick in both, so every one is found.
Items of fewer than WINDOW words are one window, which is its own pick.

Both joins are with distinct hashes.  A window's class stands for all items that have it, and the
items of a set of classes are gathered once for all documents with that set, so a passage
common to many documents and items is never multiplied out.

Defined results: a null or empty text has no words and no hits; repeated documents
are separate rows; repeated items count once by item_id; windows of an item with a
null item_id mark words but are no item; a text of any length is read whole; an empty table of
either kind gives no hits (or no rows); extra columns are ignored by `find_overlaps` and
pass through `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut_lineage, table, unused
from .textkit import ALNUM, U, Words, pieces, span_hashes

WINDOW, K = 10, 6
#: K-grams of a window.
GRAMS = WINDOW - K + 1
BITS = 24
#: Characters that are looked through at a time.
PIECE = 1 << 20
#: Rows of benchmark windows up to which joins broadcast them (about 40 bytes each); beyond, they are shuffled with SALTS.
BROADCAST_WINDOWS, SALTS = 200_000, 16
#: Window hashes up to which `drop_contaminated` looks them up in the pass over the documents (8 bytes each).
LOOKUP_WINDOWS = 4_000_000
_SMALL = np.int64


def picks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of each text's distinct picks, in order."""
    grams, at = words.grams(K)
    n = len(grams) - GRAMS + 1
    if n < 1:
        return np.zeros(0, U), np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, GRAMS):
        less = grams[j : j + n] <= best  # rightmost on ties
        best[less], place[less] = grams[j : j + n][less], np.flatnonzero(less) + j
    starts = at[:n]
    whole = starts + WINDOW <= words.first[words.doc[starts] + 1]
    place = np.unique(place[whole])
    return grams[place], at[place]


def around(words: Words, fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pick, start and hash of every whole window that holds a pick's k-gram."""
    starts = (at[:, None] - np.arange(GRAMS)).ravel()
    own, doc = np.repeat(fp, GRAMS), np.repeat(words.doc[at], GRAMS) if len(at) else at
    ok = (starts >= words.first[doc]) & (starts + WINDOW <= words.first[doc + 1]) if len(at) else np.zeros(0, bool)
    starts, own = starts[ok], own[ok]
    return own, starts, span_hashes(words.hashes, starts, starts + WINDOW) if len(starts) else np.zeros(0, U)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, ids = b.column("text").to_pylist(), b.column("item").to_pylist()
        for lo, hi in pieces(texts, PIECE):
            w = Words(texts[lo:hi], ALNUM)
            fp, at, wh = around(w, *picks(w))
            n = np.full(len(at), WINDOW)
            short = np.flatnonzero((w.n > 0) & (w.n < WINDOW))
            if len(short):
                s, e = w.first[short], w.first[short + 1]
                h = span_hashes(w.hashes, s, e)
                at, fp, wh, n = np.append(at, s), np.append(fp, h), np.append(wh, h), np.append(n, e - s)
            owner = w.doc[at] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(_SMALL)), pa.array(wh.view(_SMALL)), pa.array(n.astype(np.int32)), pa.array([ids[lo + i] for i in owner], pa.string())], ["fp", "wh", "len", "item"])


def _candidates(words: Words, known: Callable[[np.ndarray], np.ndarray], lengths: list[int]) -> tuple[np.ndarray, ...]:
    """Pick, hash, length and start of the windows of a batch whose pick and whose words may be known."""
    found = []
    if WINDOW in lengths:
        fp, at = picks(words)
        ok = known(fp)
        fp, at, wh = around(words, fp[ok], at[ok])
        ok = known(wh)
        found.append((fp[ok], wh[ok], np.full(int(ok.sum()), WINDOW), at[ok]))
    for m in lengths:
        if m < WINDOW:
            h, at = words.grams(m)
            ok = known(h)
            found.append((h[ok], h[ok], np.full(int(ok.sum()), m), at[ok]))
    if not found:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _doc_windows(bitmap: bytes, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
        known = lambda h: bits[(h >> U(64 - BITS)).astype(np.int64)]
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in pieces(texts, PIECE):
                w = Words(texts[lo:hi], ALNUM)
                fp, wh, n, at = _candidates(w, known, lengths)
                doc = w.doc[at] if len(at) else at
                order = np.argsort(doc, kind="stable")
                offsets = pa.array(np.searchsorted(doc[order], np.arange(hi - lo + 1)).astype(np.int32))
                start = (at - w.first[doc])[order] if len(at) else at
                hits = pa.StructArray.from_arrays([pa.array(fp[order].view(_SMALL)), pa.array(wh[order].view(_SMALL)), pa.array(n[order].astype(np.int32)), pa.array(start.astype(np.int64))], ["fp", "wh", "len", "start"])
                rest = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), pa.array(w.n.astype(np.int64)), pa.ListArray.from_arrays(offsets, hits)], ["doc_id", "n_words", "hits"])

    return run


def _windows_of(benchmark: DataFrame) -> DataFrame:
    """fp, wh, len, item of the windows around the benchmark's picks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_windows, "fp long, wh long, len int, item string").distinct()
    return cut_lineage(items)


def _bitmap(items: DataFrame) -> bytes:
    """2^BITS bits, whatever the benchmark's size: the picks and windows that occur."""
    bit = lambda c: F.expr(f"shiftrightunsigned({c}, {64 - BITS})") + 1
    marks = items.select(F.explode(F.array(bit("fp"), bit("wh"))).alias("bit")).select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in marks.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("m")).collect():
        at = (r["bucket"] - 1) * len(r["m"])
        out[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return out.tobytes()


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    items = _windows_of(benchmark)
    n, lengths = items.agg(F.count(F.lit(1)), F.collect_set("len")).first()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_doc_windows(_bitmap(items), sorted(lengths)), f"doc_id {doc_type}, n_words long, hits array<struct<fp:long,wh:long,len:int,start:long>>")
    rows = cut_lineage(read).withColumn("rid", F.monotonically_increasing_id())

    # Fingerprints first, then the windows around each hit; either side's hashes are distinct.
    hits = rows.where(F.size("hits") > 0).select("rid", F.inline("hits"))
    classes = items.select("fp", "wh", "len").distinct().withColumn("cls", F.xxhash64("wh", "len"))

    def looked_up(df: DataFrame, among: DataFrame, on: list[str], how: str) -> DataFrame:
        if n <= BROADCAST_WINDOWS:
            return df.join(F.broadcast(among), on, how)
        salted = among.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("salt", F.pmod(F.col("rid"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")

    hits = looked_up(hits, items.select("fp").distinct(), ["fp"], "left_semi")
    hits = looked_up(hits, classes, ["fp", "wh", "len"], "inner")
    span = F.struct("start", (F.col("start") + F.col("len")).alias("end"))
    per = hits.groupBy("rid").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("cls")).alias("classes"))

    def add(acc, x):
        reach = F.greatest(acc["reach"], x["end"])
        return F.struct(reach.alias("reach"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["reach"], x["start"]))).alias("n"))

    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    per = cut_lineage(per.select("rid", F.aggregate("spans", zero, add)["n"].alias("n_hit"), "classes", F.xxhash64("classes").alias("s1"), F.hash("classes").alias("s2")))

    # Items once for each set of classes.
    sets = per.groupBy("s1", "s2").agg(F.first("classes").alias("classes")).select("s1", "s2", F.explode("classes").alias("cls"))
    members = items.where("item IS NOT NULL").select(F.xxhash64("wh", "len").alias("cls"), "item").distinct()
    named = sets.join(members, "cls").groupBy("s1", "s2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select("s1", "s2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per = per.drop("classes").join(named, ["s1", "s2"], "left")

    known = rows.join(per, "rid", "left") if n > 0 else rows.select("*", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    return known.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose text shares no window with the benchmark, columns as they were.

    Rows pass through one scan: picks by bitmap, then windows in sorted hashes.  A benchmark of more
    than LOOKUP_WINDOWS windows is looked up by a join on the windows of the documents that the bitmap leaves.
    """
    items = _windows_of(benchmark)
    lengths = sorted(items.agg(F.collect_set("len")).first()[0])
    bitmap, spark = _bitmap(items), docs.sparkSession
    hashes = items.select("wh", "len").distinct()
    small = hashes.count() <= LOOKUP_WINDOWS
    listed = hashes.toArrow() if small else None
    shared = spark.sparkContext.broadcast({m: np.sort(listed.column("wh").to_numpy()[listed.column("len").to_numpy() == m]) for m in lengths} if small else {})
    text, name = unused(docs, "text_"), unused(docs, "windows_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
        known = lambda h: bits[(h >> U(64 - BITS)).astype(np.int64)]
        for b in batches:
            texts = b.column(text).to_pylist()
            for lo, hi in pieces(texts, PIECE):
                w = Words(texts[lo:hi], ALNUM)
                _, wh, n, at = _candidates(w, known, lengths)
                wh = wh.view(_SMALL)
                hit = np.ones(len(wh), bool)
                for m, have in shared.value.items():
                    of = np.flatnonzero(n == m)
                    hit[of] = have[np.minimum(np.searchsorted(have, wh[of]), len(have) - 1)] == wh[of]
                doc = w.doc[at[hit]] if len(at) else at
                part = b.slice(lo, hi - lo).drop_columns([text])
                if small:
                    clean = np.ones(hi - lo, bool)
                    clean[doc] = False
                    yield part.filter(pa.array(clean))
                else:
                    order = np.argsort(doc, kind="stable")
                    offsets = np.searchsorted(doc[order], np.arange(hi - lo + 1)).astype(np.int32)
                    windows = pa.StructArray.from_arrays([pa.array(wh[order]), pa.array(n[order].astype(np.int32))], ["wh", "len"])
                    yield part.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), windows))

    from pyspark.sql.types import ArrayType, StructType

    fields = StructType([*docs.schema.fields])
    named = docs.withColumn(text, F.col("text").cast("string"))
    if small:
        return named.mapInArrow(run, fields)
    marked = named.mapInArrow(run, fields.add(name, ArrayType(StructType().add("wh", "long").add("len", "integer"))))
    marked = cut_lineage(marked.withColumn(text, F.monotonically_increasing_id()))
    some = marked.where(F.size(column(name)) > 0).select(F.col(text).alias("rid"), F.inline(column(name)))
    bad = some.join(hashes, ["wh", "len"]).select("rid").distinct()
    return marked.join(bad, F.col(text) == F.col("rid"), "left_anti").select(*(column(c) for c in docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_LIST = rf"regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
b AS (SELECT item_id, {_WORD_LIST} AS w FROM benchmark),
items AS (
    SELECT item_id, {WINDOW} AS k, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW})
    UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND {WINDOW - 1}),
sizes AS (SELECT DISTINCT k FROM items),
grams AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, k, i FROM grams JOIN items USING (k, g)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(f.ids, '')) AS items_sha256, m.n IS NOT NULL AS contaminated
FROM d LEFT JOIN marked m USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
