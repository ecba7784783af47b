"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a document are the hashed buckets of its words, each with its share of the words, and a
one-hot bin for each structure statistic and for its length.  The score is the
logistic of bias, linear terms and all pairwise terms <v_i, v_j> x_i x_j, which the
identity sum_f ((sum v x)^2 - sum v^2 x^2) / 2 gives in time linear in the words.
Fitted on the driver by AdaGrad over a bounded labelled sample; scoring is one pass.

Defined results: a null or empty text is scored by its (lowest) bins alone; without
labels of both kinds every score is the share of good labels (0 if none); repeated
rows are scored alike; a text of any length is scored whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import fold, labelled_sample
from .textkit import ALNUM, SPACED, U, Words, pieces

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
SAMPLE, BUCKETS, RANK, BINS = 6000, 1 << 13, 6, 12
STEPS, BATCH, RATE, DECAY = 1500, 64, 0.08, 2e-5
N_STATS = 16


def statistics(texts: list, w: Words) -> np.ndarray:
    """[text, N_STATS]: shares of kinds of characters, repetition, lines and length."""
    n = len(texts)
    size = np.maximum(w.doc_end - w.doc_start, 1).astype(float)
    raw = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    part = lambda mask: np.add.reduceat(mask.astype(np.int64), w.doc_start).astype(float) if n else np.zeros(0)
    sign = (raw > 32) & (raw < 127) & ~ALNUM[w.data]
    plain = np.isin(raw, np.frombuffer(b".,;:?'\"-()", np.uint8))
    letters = np.maximum(part(ALNUM[w.data] & ~((raw >= 48) & (raw <= 57))), 1)
    words = np.maximum(w.n, 1).astype(float)
    length = (w.ends - w.starts).astype(float)
    sums = lambda x: np.bincount(w.doc, x, n)
    order = np.lexsort((w.hashes, w.doc))
    h, d = w.hashes[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    distinct = np.bincount(d[at], minlength=n).astype(float)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    ends = np.isin(w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8), np.frombuffer(b"!#&$%*|", np.uint8))
    return np.stack([
        100 * part(sign & ~plain) / size, 100 * part(plain) / size, 100 * part((raw >= 65) & (raw <= 90)) / letters, 100 * part((raw >= 48) & (raw <= 57)) / size,
        100 * part(raw == ord("!")) / size, 100 * part(raw == ord("|")) / size, sums(length) / words, 100 * sums(length > 20) / words,
        100 * distinct / words, 100 * top / words, 100 * sums(again) / words, 100 * sums(ends) / words,
        100 * part(raw == 10) / words, 100 * part((raw == 46) | (raw == 63)) / words, np.log1p(w.n), 100 * part(raw >= 128) / size,
    ], 1)


def inputs(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's features begin (and the end of all), the distinct word buckets, each one's share of the text's words, and the statistics."""
    w = Words(texts, SPACED)
    keys, counts = np.unique(w.doc * BUCKETS + (w.hashes >> U(64 - 13)).astype(np.int64), return_counts=True)
    doc = keys // BUCKETS
    return np.searchsorted(doc, np.arange(len(texts) + 1)), keys % BUCKETS, counts / w.n[doc], statistics(texts, w)


class Machine:
    """Weights of the machine; the first BUCKETS features are words, then bins of the statistics."""

    def __init__(self, share: float, edges: list[np.ndarray]):
        self.share, self.edges, self.w = share, edges, None

    def bins(self, stats: np.ndarray) -> np.ndarray:
        cols = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, stats.T)]
        return np.stack(cols, 1) + BUCKETS + np.arange(N_STATS) * BINS

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray) -> Machine:
        """docs: distinct buckets and their shares, for each document."""
        rng = np.random.Generator(np.random.PCG64(8))
        size = BUCKETS + N_STATS * BINS
        w, v = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
        bias = float(np.log(self.share / (1 - self.share)))
        gw, gv, gb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
        bins = self.bins(stats)
        for _ in range(-(-STEPS * BATCH // len(y))):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                part = order[lo : lo + BATCH]
                idx = np.concatenate([np.concatenate((docs[i][0], bins[i])) for i in part])
                x = np.concatenate([np.concatenate((docs[i][1], np.ones(N_STATS) / N_STATS**0.5)) for i in part])
                start = np.cumsum([0] + [len(docs[i][0]) + N_STATS for i in part])
                owner = np.repeat(np.arange(len(part)), np.diff(start))
                vx = v[idx] * x[:, None]
                s = np.add.reduceat(vx, start[:-1])
                f = bias + np.add.reduceat(w[idx] * x, start[:-1]) + 0.5 * (s**2 - np.add.reduceat(vx**2, start[:-1])).sum(1)
                off = (y[part] - 1 / (1 + np.exp(-f)))[owner] / len(part)
                used, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, off * x) - DECAY * w[used]
                per = (off * x)[:, None] * (s[owner] - vx)
                dv = np.stack([np.bincount(back, per[:, k]) for k in range(RANK)], 1) - DECAY * v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                w[used] += RATE * dw / np.sqrt(gw[used])
                v[used] += RATE * dv / np.sqrt(gv[used])
                db = float(off.sum() / max(1, len(owner)))
                gb += db**2
                bias += RATE * db / gb**0.5
        self.w, self.v, self.bias = w, v.astype(np.float32), bias
        return self

    def score(self, texts: list) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.share)
        first, idx, x, stats = inputs(texts)
        n, some = len(texts), np.flatnonzero(np.diff(first))
        lin, s, sq = np.zeros(n), np.zeros((n, RANK)), np.zeros((n, RANK))
        if len(some):
            at, vx = first[:-1][some], self.v[idx] * x[:, None]
            lin[some] = np.add.reduceat(self.w[idx] * x, at)
            s[some] = np.add.reduceat(vx, at)
            sq[some] = np.add.reduceat(vx * vx, at)
        b, x = self.bins(stats), 1 / N_STATS**0.5
        vb = self.v[b] * x
        s, sq, lin = s + vb.sum(1), sq + (vb**2).sum(1), lin + self.w[b].sum(1) * x
        return 1 / (1 + np.exp(-(self.bias + lin + 0.5 * (s**2 - sq).sum(1))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_size: int = SAMPLE) -> Machine:
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, sample_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in pieces(texts, 1 << 19):
                first, idx, x, stats = inputs(texts[lo:hi])
                at = pa.array(first.astype(np.int32))
                words, shares = pa.ListArray.from_arrays(at, pa.array(idx.astype(np.int16))), pa.ListArray.from_arrays(at, pa.array(x))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * N_STATS), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([words, shares, flat, b.column("y").slice(lo, hi - lo)], ["words", "shares", "stats", "y"])

    # At most BUCKETS features a row, whatever a text's length.
    got = sample.mapInArrow(run, "words array<short>, shares array<double>, stats array<double>, y int").toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    share = float(y.mean()) if len(y) else 0.0
    stats = np.array(got.column("stats").to_pylist()).reshape(-1, N_STATS)
    lists = lambda c, kind: [np.array(x.values, kind) if x.values is not None else np.zeros(0, kind) for x in got.column(c)]
    words = list(zip(lists("words", np.int64), lists("shares", float)))
    order = sorted(range(len(y)), key=lambda i: (*stats[i], len(words[i][0]), y[i]))  # the same on every run
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for c in stats.T]
    edges = [np.unique(np.append(e, [c.max()])[: BINS - 1]) if len(e) and c.max() > e[-1] and len(e) < BINS - 1 else e for e, c in zip(edges, stats.T)]
    model = Machine(share, edges)
    return model.fit([words[i] for i in order], stats[order], y[order]) if 0 < share < 1 else model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in pieces(texts, 1 << 19):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(shared.value.score(texts[lo:hi]))], ["doc_id", "score"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, score double")
    return scored.select("doc_id", (F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(-1)) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
