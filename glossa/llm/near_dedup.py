"""Near-duplicate detection with SetSketch registers.

A document is the set of its distinct shingles of SHINGLE words.  Its sketch has BANDS *
ROWS registers, each an exponentially spaced truncated minimum: floor(1 - log_b(x)) of
the smallest exponential variate x over the set, so sketches of unions are maxima of
sketches and equal registers are about as likely as the Jaccard similarity.  Documents
with equal sets are one class.  Classes that agree in all registers of a band are
candidates: each is tried against the first and last class of its band value (two
stars, linear in the bucket); buckets that then hold several components get stars
around drawn members, and what is still open after ROUNDS of these is compared
across components on the full sets, block by block.  Star candidates whose registers
make a similarity of THRESHOLD very unlikely (joint likelihood of greater, less and
equal registers) are dropped, all others are verified on the full sets of shingles.

Two sets at the threshold agree in some band but for a chance of 3e-7.

Defined results: texts without words, null and empty ones have no shingles and link
with nothing; texts of fewer than SHINGLE words are one shingle; repeated rows and
copies are one class; a null doc_id never names a component that has another; a text of any
length is read whole (one text's shingles are held at a time); an empty table gives an empty result;
extra columns pass through `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut_lineage, table, unused
from .components import components
from .textkit import SPACED, U, Words, mix, pieces, span_hashes

SHINGLE = 5
#: The threshold, in hundredths.
THRESHOLD = 75
BANDS, ROWS = 40, 4
M = BANDS * ROWS
#: SetSketch base, rate and largest register.
B, RATE, TOP = 1.001, 20.0, (1 << 15) - 1
#: A pair goes on if its likelihood at the threshold or above is within exp(-SLACK) of the best.
SLACK = 18.0
#: Members of a bucket that are compared at once; classes up to which a lookup is broadcast (24 bytes each).
BLOCK, BROADCAST_ROWS, COLUMNS = 512, 400_000, 1024
#: Tasks that the members of one band value are dealt over in joins.
SALTS = 16
#: Rounds of stars around drawn members, and the buckets of a member that each tries.
ROUNDS, TRIES = 1, 6
#: Rows of a small intermediate result that one task reads.
FEW = 20_000
_RNG = np.random.Generator(np.random.PCG64(75))
_XOR, _MUL = _RNG.integers(0, 1 << 63, M, dtype=np.uint64), _RNG.integers(0, 1 << 63, M, dtype=np.uint64) | U(1)


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and how many each has."""
    w = Words(texts, SPACED)
    grams, at = w.grams(SHINGLE)
    cut = np.searchsorted(at, w.first)
    short = (w.n > 0) & (w.n < SHINGLE)
    whole = span_hashes(w.hashes, w.first[:-1], w.first[1:]) if len(w.hashes) else None
    sets = [whole[i : i + 1] if short[i] else np.unique(grams[cut[i] : cut[i + 1]]) for i in range(len(texts))]
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.fromiter(map(len, sets), np.int64, len(sets))


def registers(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """int16 registers [set, M] of the sets that begin at `starts` (none of them empty)."""
    low = np.empty((len(starts), M))
    with np.errstate(over="ignore"):
        for i in range(M):
            low[:, i] = np.minimum.reduceat(((sets ^ _XOR[i]) * _MUL[i]) >> U(32), starts)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.int16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in pieces(texts, 1 << 19):
            sets, n = shingle_sets(texts[lo:hi])
            some = np.flatnonzero(n)
            packed = np.zeros((hi - lo, BANDS), np.int64)
            sums = np.zeros((2, hi - lo), U)
            if len(some):
                starts = (np.cumsum(n) - n)[some]
                packed[some] = registers(sets, starts).view(np.int64)
                sums[0, some] = np.add.reduceat(sets, starts)
                sums[1, some] = np.bitwise_xor.reduceat(mix(sets + U(0x5BD1E995)), starts)
            rest = b.slice(lo, hi - lo)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(packed.ravel()))
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("th"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), sketch], ["doc_id", "th", "n", "s1", "s2", "sketch"])


def _log_likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of similarity j, given the share u of the first set in both sizes and counts of registers."""
    v = 1 - u
    p = lambda x: -np.log(np.maximum(1 - np.maximum(x, 0) * (B - 1) / B, 1e-300)) / np.log(B)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return more * log(up) + less * log(down) + same * log(1 - up - down)


def plausible(na: np.ndarray, nb: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Whether pairs may reach the threshold, by sizes and by the registers' joint likelihood."""
    fits = 100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb)
    more, less = (ra > rb).sum(-1), (ra < rb).sum(-1)
    same, u = M - more - less, na / (na + nb)
    grid = np.linspace(0, 1, 51)
    most = np.minimum(u / (1 - u), (1 - u) / u)
    ll = np.stack([np.where(j <= most + 1e-9, _log_likelihood(np.minimum(j, most), u, more, less, same), -np.inf) for j in (*grid, most)])
    near = np.append(grid >= THRESHOLD / 100, True)
    return fits & (ll[near].max(0) >= ll.max(0) - SLACK)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = lambda c: c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()].reshape(-1, BANDS).view(np.int16)
    for b in batches:
        if b.num_rows:
            keep = plausible(b.column("na").to_numpy(), b.column("nb").to_numpy(), unpack(b.column("sa")), unpack(b.column("sb")))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])


def _across(group: pa.Table) -> pa.Table:
    """Links of the few members with any other of another label, on full sets.

    Of all links, as many are returned as it takes to join the labels.
    """
    names, label = np.unique(group.column("label").to_numpy(), return_inverse=True)
    pairs = lambda rows: pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate("ab")})
    if len(names) < 2:
        return pairs([])
    sets, n = shingle_sets(group.column("text").to_pylist())
    _, col, count = np.unique(sets, return_inverse=True, return_counts=True)
    shared = count > 1
    owner, col = np.repeat(np.arange(len(n)), n)[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    is_few = group.column("few").to_numpy()
    few, every = np.flatnonzero(is_few), np.flatnonzero(~is_few)
    common = np.zeros((len(few), len(every)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(col, (lo, lo + COLUMNS))
        has = np.zeros((len(n), COLUMNS), np.float32)
        has[owner[i:j], col[i:j] - lo] = 1
        common += has[few] @ has[every].T
    linked = 100 * common >= THRESHOLD * (n[few, None] + n[every][None] - common)
    linked &= label[few, None] != label[every][None]
    i, j = np.nonzero(linked)
    j = every[j]
    _, first = np.unique(label[few[i]].astype(np.int64) * len(names) + label[j], return_index=True)
    root = list(range(len(names)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    cid, out = group.column("cid").to_numpy(), []
    for k in first:
        u, v = find(label[few[i[k]]]), find(label[j[k]])
        if u != v:
            root[u] = v
            out.append((cid[few[i[k]]], cid[j[k]]))
    return pairs(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
        ta, tb = b.column("ta"), b.column("tb")
        kept: dict[int, np.ndarray] = {}
        ok = np.zeros(len(a), bool)
        for i in np.argsort(a, kind="stable"):
            if len(kept) > 64:
                kept.clear()
            for k, t in ((a[i], ta), (c[i], tb)):
                if k not in kept:
                    kept[k] = shingle_sets([t[int(i)].as_py()])[0]
            x, y = kept[a[i]], kept[c[i]]
            common = len(x) + len(y) - len(np.union1d(x, y))
            ok[i] = 100 * common >= THRESHOLD * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], ["a", "b"])


def _texts(cids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, text of the class's first document, for the distinct cids."""
    nodes = cut_lineage(cids.distinct().join(classes.select("cid", "rep"), "cid").select("cid", F.col("rep.id").alias("id"), F.col("rep.th").alias("th")), FEW)
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(nodes, th.eqNullSafe(F.col("th")) & F.col("d").eqNullSafe(F.col("id")))
    return texts.groupBy("cid").agg(F.first("text").alias("text"))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of classes that reach the threshold: estimated first, then on full sets."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_estimate, "a long, b long")
    likely = cut_lineage(likely, FEW)
    texts = _texts(likely.select(F.explode(F.array("a", "b")).alias("cid")), classes, docs)
    both = likely.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    return cut_lineage(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), FEW)


def _paired(rows: DataFrame, other: str) -> DataFrame:
    return rows.select(F.least("cid", other).alias("a"), F.greatest("cid", other).alias("b")).where("a <> b").distinct()


def _by_key(members: DataFrame, few: DataFrame) -> DataFrame:
    """members joined with one row for each band value; the members of one value go to SALTS tasks."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), n_shingles, component_id, kept and class (label of the component) for each row of `docs`."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = cut_lineage(rows.mapInArrow(_sketch, f"doc_id {doc_type}, th long, n long, s1 long, s2 long, sketch array<long>"))

    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "th")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))

    bands = classes.select("cid", F.posexplode("sketch").alias("band", "value")).select("cid", F.xxhash64("band", "value").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    members = cut_lineage(_by_key(bands, buckets), 4 * FEW)
    edges = _links(_paired(members.select("cid", F.explode(F.array("lo", "hi")).alias("to")), "to"), classes, docs)
    labels = cut_lineage(components(edges), FEW)

    # In buckets of up to three the two stars are all pairs; larger ones may still hold several components.
    members = members.where("size > 3").select("cid", "key", "size")

    def mixed(seed: int) -> tuple[DataFrame, DataFrame]:
        named = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "size", F.coalesce("label", "cid").alias("label"))
        nth = F.xxhash64("cid", "key", F.lit(seed))
        open_ = named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min_by("cid", nth).alias("center"), F.min_by("label", nth).alias("at")).where("l0 < l1")
        return named, open_.select("key", "center", "at")

    # Stars around members drawn for each bucket on its own join most of what is left.
    for seed in range(ROUNDS):
        named, open_ = mixed(seed)
        tried = _by_key(named, open_).where("label <> at")
        nth = F.row_number().over(Window.partitionBy("cid").orderBy(F.xxhash64("key", F.lit(seed)), "key"))
        more = _links(_paired(tried.withColumn("nth", nth).where(F.col("nth") <= TRIES), "center"), classes, docs)
        if not more.take(1):
            break
        edges = cut_lineage(edges.unionByName(more), FEW)
        labels = cut_lineage(components(edges), FEW)

    # What is open now is compared exactly: in each bucket the members outside its most frequent
    # label with all members, buckets of the same such label taken together.
    named, open_ = mixed(ROUNDS)
    named = cut_lineage(_by_key(named, open_.select("key")), 4 * FEW)
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    left = cut_lineage(_by_key(named, main).select("main", "cid", "label").distinct(), FEW)
    few = F.sum((F.col("label") != F.col("main")).cast("long"))
    blocks = left.groupBy("main").agg(F.ceil(few / BLOCK).alias("xs"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("ys"))
    left = left.join(_texts(left.select("cid"), classes, docs), "cid").join(blocks, "main")
    at = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    row = ["main", "cid", "label", "text"]
    few_rows = left.where("label <> main").select(*row, F.lit(True).alias("few"), at("xs").alias("x"), upto("ys").alias("y"))
    left = few_rows.unionByName(left.select(*row, F.lit(False).alias("few"), upto("xs").alias("x"), at("ys").alias("y")))
    more = cut_lineage(left.groupBy("main", "x", "y").applyInArrow(_across, "a long, b long").distinct(), FEW)
    if more.take(1):
        labels = cut_lineage(components(edges.unionByName(more)))

    placed = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("s1", "s2", F.coalesce("label", "cid").alias("label"), F.col("rep.id").alias("id"))
    first = placed.groupBy("label").agg(F.min("id").alias("component"))
    placed = placed.join(first, "label").select("s1", "s2", "component", F.col("label").alias("class"))
    own = rows.drop("sketch").join(placed, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, columns as they were; documents without words all stay.

    Of a group the row of the smallest (doc_id, text hash) stays, null ids last; of rows alike in both, one.
    Texts of groups of more than one row are listed with the id that stays, if any; while the list
    is short, rows pass it in one scan, and else both are shuffled by text hash.
    """
    found = find_near_duplicates(docs).where("n_shingles > 0").select("doc_id", "th", "class")
    found = cut_lineage(found)
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "th")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = cut_lineage(found.select("class", "th").distinct().join(best, "class").select("th", (F.col("th") == F.col("best.th")).alias("stays"), F.col("best.id").alias("id")).distinct(), FEW)
    th, stays, id_ = (unused(docs, n) for n in ("th_", "stays_", "id_"))
    listed = texts.select(F.col("th").alias(th), F.col("stays").alias(stays), F.col("id").alias(id_))
    rows = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    theirs = F.col(stays) & F.col("doc_id").eqNullSafe(F.col(id_))
    nth = F.row_number().over(Window.partitionBy(th, "doc_id").orderBy(F.lit(0)))
    columns = [column(c) for c in docs.columns]
    if texts.count() <= BROADCAST_ROWS:
        alone = rows.join(F.broadcast(listed), th, "left_anti").select(*columns)
        one = rows.join(F.broadcast(listed.where(F.col(stays))), th).where(theirs).withColumn(stays, nth).where(F.col(stays) == 1)
        return alone.unionByName(one.select(*columns))
    joined = rows.join(listed, th, "left").where(F.col(stays).isNull() | theirs)
    return joined.withColumn(id_, nth).where(F.col(stays).isNull() | (F.col(id_) == 1)).select(*columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents")).drop("th", "class")


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS node, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c.low, s.doc_id) AS component_id, coalesce(c.low, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.node
"""
