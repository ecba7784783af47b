"""How far the sources of a language differ in the terms they use.

Terms are runs of ASCII letters and of all beyond ASCII, with only A to Z lower-cased.  In each
task the texts of a batch are one buffer of UTF-8 bytes: a numpy lookup table tells letters from
the rest and so finds where terms begin and end, xxhash groups the slices, and the bytes of each are
compared with those of its group's first, so that slices of one hash but other bytes are
told apart.  What leaves numpy is one row of each slab for each term and (language, source) with its
occurrences and documents; Spark adds them up, first within each task.

Terms in enough documents of a language are kept.  The kept counts are dealt to blocks of
terms (CELLS counts each, so a language has as many blocks as it needs) and to chunks of SOURCES
sources; each block becomes a CSR matrix of sources by terms.  Sums of absolute
differences of two rows are taken over the second one's entries by reduceat and over the rest
in closed form, and added up over blocks.  Of each source a block gives its own TOP terms that
stand out; the final ranks are taken among those.  All arithmetic is in whole numbers.

Defined results: null text, language and source are empty strings; a document without terms still
counts as one of its group, and such groups have divergences like others; with no kept term every value
of a language's pairs is 0; repeated rows count as separate documents, whatever their ids; texts and
terms of any length are taken whole (a text goes in slabs of SLAB bytes, cut between terms);
equal values are ranked by the item's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .textkit import LOWER

#: Bytes of terms: letters and everything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a slab.
SLAB = 1 << 21
#: Documents in which a term must occur, the scale of shares, what is added to each count, terms of each group.
LEAST, SCALE, ADDED, TOP = 30, 1_000_000_000, 5, 50
#: Counts of a block, sources of a chunk, and languages whose totals are broadcast.
CELLS, SOURCES, LANGUAGES = 50_000, 256, 10_000

COUNTED = "lang string, source string, term binary, n long, docs long"
_NAMES = ["lang", "source", "term", "n", "docs"]


class TermCounts:
    """Occurrences and documents of each (group, term), slab by slab."""

    def of(self, data: np.ndarray, first: np.ndarray, groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """COUNTED rows of the texts of one buffer: text i of group i lies from first[i] to first[i + 1]."""
        names = list(dict.fromkeys(groups))
        number = {g: i for i, g in enumerate(names)}
        group = np.fromiter((number[g] for g in groups), np.int64, len(groups))
        langs, sources = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        none = np.zeros(len(names), np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(names), pa.binary()), pa.array(none), pa.array(none)], _NAMES)
        at, doc = 0, -1
        open_doc: set[bytes] = set()  # terms of the text that the last slab ended in
        while at < len(data):
            end = self._cut(data, first, at)
            starts, ends = self._slices(data, first, at, end)
            docs = np.searchsorted(first, starts, "right") - 1
            lead, ids = self._grouped(data, starts, ends)
            width = max(1, len(lead))
            pairs, times = np.unique(docs * width + ids, return_counts=True)
            in_doc, term = np.divmod(pairs, width)
            new = np.ones(len(pairs), np.int64)
            for i in np.flatnonzero(in_doc == doc) if open_doc else ():
                new[i] = data[starts[lead[term[i]]] : ends[lead[term[i]]]].tobytes() not in open_doc
            last = int(np.searchsorted(first, end - 1, "right")) - 1
            if last != doc:
                open_doc.clear()
            if first[last + 1] > end:
                open_doc.update(data[starts[lead[t]] : ends[lead[t]]].tobytes() for t in term[in_doc == last])
            doc, at = last, end
            keys, place = np.unique(group[in_doc] * width + term, return_inverse=True)
            which, term = np.divmod(keys, width)
            size = np.zeros((2, len(keys)), np.int64)
            np.add.at(size[0], place, times)
            np.add.at(size[1], place, new)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(which)), sources.take(pa.array(which)), _sliced(data, starts[lead[term]], ends[lead[term]]), pa.array(size[0]), pa.array(size[1])], _NAMES)

    @staticmethod
    def _cut(data: np.ndarray, first: np.ndarray, at: int) -> int:
        """Where a slab from `at` ends: between texts or at a byte that is no letter."""
        if len(data) - at <= SLAB:
            return len(data)
        i = int(np.searchsorted(first, at + SLAB, "right")) - 1
        if first[i] > at:
            return int(first[i])
        end = at + SLAB
        while end < len(data) and end not in (first[i + 1],) and LETTER[data[end]]:
            step = LETTER[data[end : min(end + SLAB, first[i + 1])]]
            stop = int(np.argmin(step))
            end += stop if not step[stop] else len(step)
        return end

    @staticmethod
    def _slices(data: np.ndarray, first: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        inside = LETTER[data[at:end]]
        before = np.concatenate([[False], inside[:-1]])
        edges = first[(first > at) & (first < end)] - at
        starts = inside & ~before
        starts[edges] = inside[edges]
        stops = before & ~inside
        stops[edges] |= before[edges]
        ends = np.flatnonzero(stops)
        if inside[-1]:
            ends = np.append(ends, end - at)
        return np.flatnonzero(starts) + at, ends + at

    @staticmethod
    def _grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each distinct slice, and for each slice its number among those."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = int(starts[0])
        raw = data[base : int(ends[-1])].tobytes()
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(raw[a:b]) for a, b in zip((starts - base).tolist(), (ends - base).tolist(), strict=True)), np.uint64, len(starts))
        _, lead, ids = np.unique(hashes, return_index=True, return_inverse=True)
        # Every slice against the first one of its hash, byte by byte.
        size, own = ends - starts, lead[ids]
        same = size == size[own]
        at, run = _positions(starts, np.where(same, size, 0))
        unlike = data[at] != data[at + np.repeat(starts[own] - starts, run)]
        if unlike.any():
            same[np.repeat(np.arange(len(starts)), run)[unlike]] = False
        extra: dict[bytes, int] = {}
        more: list[int] = []
        for i in np.flatnonzero(~same).tolist():
            term = raw[starts[i] - base : ends[i] - base]
            if term not in extra:
                extra[term] = len(lead) + len(more)
                more.append(i)
            ids[i] = extra[term]
        return np.append(lead, more).astype(np.int64), ids.astype(np.int64)


def _positions(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all bytes of the slices in turn, and the sizes."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes), sizes


def _sliced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    at, sizes = _positions(starts, ends - starts)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = TermCounts()
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column("text").cast(pa.large_binary())
        first = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        whole = text.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[first[0] : first[-1]] if whole is not None else np.zeros(0, np.uint8)
        groups = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
        yield from counts.of(LOWER[data], first - first[0], groups)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs; a row with a null term for every group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact however large."""
    if len(counts) and int(counts.max()) + ADDED >= (1 << 63) // SCALE:
        counts, total = counts.astype(object), total.astype(object)
    return np.asarray(1 + SCALE * (counts + ADDED) // (total + ADDED * terms), np.int64)


def pair_sums(ptr: np.ndarray, col: np.ndarray, val: np.ndarray, zero: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
    """Sums of |row a - row b| over all columns, for a of `rows` and all b.

    Rows are those of a CSR matrix whose missing entries are zero[row].
    """
    n = len(ptr) - 1
    filled = np.diff(ptr)
    some = filled > 0
    row_of = np.repeat(np.arange(n), filled)
    out = np.zeros((len(rows), n), np.int64)
    for k, a in enumerate(rows):
        mine, at = val[ptr[a] : ptr[a + 1]], col[ptr[a] : ptr[a + 1]]
        # All columns against zero[b]: the entries of a by sorted prefix sums, the others are alike.
        up = np.sort(mine)
        upto = np.concatenate([[0], np.cumsum(up)])
        i = np.searchsorted(up, zero)
        out[k] = zero * i - upto[i] + (upto[-1] - upto[i]) - zero * (len(up) - i) + np.abs(zero[a] - zero) * (width - len(up))
        # Where b has an entry: the difference to it in place of that to zero[b].
        line = np.full(width, zero[a])
        line[at] = mine
        against = line[col]
        change = np.abs(against - val) - np.abs(against - zero[row_of])
        if len(change):
            out[k][some] += np.add.reduceat(change, ptr[:-1][some])
    return out


def _diverge(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of terms of a language: differences of its sources' pairs, and the terms that stand out."""
    lang, chunk = key[0].as_py(), key[1].as_py()
    groups = groups.sort_by("source")
    names = groups.column("source").to_pylist()
    number = {s: i for i, s in enumerate(names)}
    total, terms = groups.column("total").to_numpy().astype(np.int64), groups.column("terms").to_numpy().astype(np.int64)
    row = np.fromiter((number[s] for s in cells.column("source").to_pylist()), np.int64, cells.num_rows)
    words, col = np.unique(np.array(cells.column("term").to_pylist(), object), return_inverse=True)
    n = cells.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order].astype(np.int64), n[order]
    ptr = np.searchsorted(row, np.arange(len(names) + 1))
    val = shares(n, total[row], terms[row])
    zero = shares(np.zeros(len(names), np.int64), total, terms) if terms[0] else np.zeros(len(names), np.int64)
    rows = np.flatnonzero(groups.column("own").to_numpy() == chunk)
    sums = pair_sums(ptr, col, val, zero, len(words), rows)
    out: list[tuple] = []
    for k, a in enumerate(rows.tolist()):
        out += [(names[a], "pair", names[b].encode(), int(v)) for b, v in enumerate(sums[k].tolist()) if b != a]
    of_lang = np.zeros(len(words), np.int64)
    np.add.at(of_lang, col, n)
    more = val - shares(of_lang, groups.column("all").to_numpy().astype(np.int64)[:1], terms[:1])[col]
    for a in rows.tolist():
        own = slice(ptr[a], ptr[a + 1])
        best = sorted((-int(v), words[c]) for v, c in zip(more[own].tolist(), col[own].tolist(), strict=True) if v > 0)[:TOP]
        out += [(names[a], "term", word, -v) for v, word in best]
    source, part, item, value = zip(*out, strict=True) if out else ((),) * 4
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.binary()), "value": pa.array(value, pa.int64())})


def divergences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    per_term = Window.partitionBy("lang", "term")  # as many rows as sources have the term
    counted = term_counts(docs).withColumn("kept", F.sum("docs").over(per_term) >= least)
    counted = cut_lineage(counted.where("kept OR term IS NULL").select("lang", "source", "term", "n"))
    cells = counted.where("term IS NOT NULL")
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Per language: kept terms, all occurrences, and blocks and chunks for its counts and sources.
    seen = counted.groupBy("lang").agg(F.sum("n").alias("all"), F.count("term").alias("cells"), F.sum(F.col("term").isNull().cast("long")).alias("sources"))
    kept = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = seen.join(kept, "lang", "left").select("lang", "all", F.coalesce("terms", F.lit(0)).alias("terms"), F.ceil(F.greatest("cells", F.lit(1)) / CELLS).cast("int").alias("blocks"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("chunks"))
    langs = cut_lineage(langs)
    if langs.count() <= LANGUAGES:
        langs = F.broadcast(langs)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = cells.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("chunk", each("chunks")).select("lang", "chunk", "block", "source", "term", "n")
    groups = groups.join(langs, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int"))
    groups = groups.withColumn("block", each("blocks")).withColumn("chunk", each("chunks"))
    groups = groups.select(*(F.col(c).alias(c) for c in ("lang", "chunk", "block", "source", "total", "terms", "all", "own")))
    by = ["lang", "chunk", "block"]
    made = cells.groupBy(*by).cogroup(groups.groupBy(*by)).applyInArrow(_diverge, "lang string, source string, part string, item binary, value long")
    pairs = made.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = made.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP)
    every = pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
    return every.select("lang", "source", "part", F.col("item").cast("string").alias("item"), F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS in_docs FROM found GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING sum(in_docs) >= {LEAST}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
cells AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n FROM counted c JOIN kept USING (lang, term)),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(x.total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source LEFT JOIN langs l ON l.lang = g.lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + {ADDED}) // (g.total + {ADDED} * g.v) AS p,
        1 + CAST({SCALE} AS HUGEINT) * (k.n + {ADDED}) // (l.total + {ADDED} * l.v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
