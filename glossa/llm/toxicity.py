"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learnt from the labelled sample (counts of
toxic and other documents for each, gathered by a distributed aggregation); features
are its densities, its hits near second-person words, capitals, punctuation,
repetition and obfuscation rates.  For a training document its own label is taken out
of the lexicon's counts.  Trees are fitted on the driver, on at most 2 * SAMPLE rows;
scoring is one pass over the documents.

Defined results: a null or empty text gets the score of a document without any
feature; without labels of both kinds every score is the share of toxic labels
(0 if there are none); repeated rows are scored alike; a text of any length is scored whole; an
empty table gives an empty result; extra columns are ignored by `score_toxicity` and kept by `drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused
from .labelled import fold, labelled_sample
from .textkit import ALNUM, BYTE_VALUES, U, Words, mix, pieces, span_hashes

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
#: Labelled documents that are fitted on, lexicon entries, and documents an entry must be in.
SAMPLE, ENTRIES, SEEN = 16_000, 16_384, 3
STRONG, NEAR = 3.0, 5
PREFIXES = (4, 5, 6, 7, 8)
#: Second-person words of the corpus languages.
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer usted ustedes ti tus su vosotros vuestro".split()
#: Signs that stand for letters in disguised words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(a) for a in LEET]] = [ord(b) for b in LEET.values()]
_WORD = ALNUM.copy()
_WORD[[ord("@"), ord("$")]] = True
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 8.0
N_FEATURES = 13


class _Canonical(Words):
    """Words with disguises undone; `data` keeps the bytes as written in lower case."""

    def __init__(self, texts: list):
        super().__init__(texts, _WORD)
        plain = _PLAIN[self.data]
        self.keys = [span_hashes(BYTE_VALUES[plain], self.starts, self.ends)] if len(self.starts) else [self.hashes]
        for k in PREFIXES:  # a shorter word has no beginning of k bytes
            h = span_hashes(BYTE_VALUES[plain], self.starts, np.minimum(self.starts + k, self.ends)) if len(self.starts) else self.hashes
            self.keys.append(np.where(self.ends - self.starts > k, mix(h ^ U(k)), U(0)))


def _you() -> np.ndarray:
    w = Words([" ".join(YOU)], ALNUM)
    return np.sort(w.hashes)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each key, by label: key, pos, neg; summed up for each batch."""
    for b in batches:
        texts, y = b.column("text").to_pylist(), b.column("y").to_numpy()
        for lo, hi in pieces(texts, 1 << 19):
            w = _Canonical(texts[lo:hi])
            found = [np.stack([k[k != 0], w.doc[k != 0].astype(U)], 1) for k in w.keys]
            pairs = np.unique(np.concatenate(found), axis=0) if len(w.hashes) else np.zeros((0, 2), U)
            keys, back = np.unique(pairs[:, 0], return_inverse=True)
            pos = np.bincount(back, y[lo:hi][pairs[:, 1].astype(np.int64)], len(keys)).astype(np.int64)
            every = np.bincount(back, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(every - pos)], ["key", "pos", "neg"])


class Lexicon:
    """Keys with the numbers of toxic and other documents that have them."""

    def __init__(self, keys: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int):
        order = np.argsort(keys)
        self.keys, self.pos, self.neg = keys[order], pos[order], neg[order]
        self.prior = np.log((n_neg + 1) / (n_pos + 1))

    def weights(self, keys: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Log odds of each key, 0 if too few documents have it; own: labels of the documents they are in."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        pos, neg = self.pos[at].astype(float), self.neg[at].astype(float)
        if own is not None:
            pos, neg = pos - own, neg - (1 - own)
        w = np.log((np.maximum(pos, 0) + 0.1) / (np.maximum(neg, 0) + 0.6)) + self.prior
        return np.where((self.keys[at] == keys) & (pos >= SEEN - 1), np.maximum(w, 0), 0)


def features(texts: list, lexicon: Lexicon, y: np.ndarray | None = None) -> np.ndarray:
    """[text, N_FEATURES]; with y, each document's own label is left out of the lexicon."""
    w = _Canonical(texts)
    n_docs, n = len(texts), w.n.astype(float)
    own = None if y is None else y[w.doc].astype(float)
    sums = lambda x: np.bincount(w.doc, x, n_docs)

    def most(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n_docs)
        some = np.flatnonzero(w.n)
        if len(some):
            out[some] = np.maximum.reduceat(x, w.first[:-1][some])
        return out

    word = lexicon.weights(w.keys[0], own)
    begin = np.max([lexicon.weights(k, own) for k in w.keys[1:]], axis=0) if len(word) else word
    best = np.maximum(word, begin)
    hit = best >= STRONG
    you = np.isin(w.hashes, _you())
    near = np.zeros(len(you), bool)
    for d in range(1, NEAR + 1):
        same = w.doc[d:] == w.doc[:-d]
        near[d:] |= you[:-d] & same
        near[:-d] |= you[d:] & same
    size = np.maximum(w.doc_end - w.doc_start, 1).astype(float)
    raw = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    part = lambda mask: np.add.reduceat(mask.astype(np.int64), w.doc_start) if n_docs else np.zeros(0)
    upper = part((raw >= 65) & (raw <= 90))
    letters = np.maximum(part(((w.data >= 97) & (w.data <= 122)) | (w.data >= 128)), 1)
    loud = part((raw == 33) | (raw == 63))
    signs = part((raw > 32) & (raw < 127) & ~ALNUM[w.data])
    same3 = np.zeros(len(raw), bool)
    same3[2:] = (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    digit = (_PLAIN[w.data] != w.data) & _WORD[w.data]
    counts = np.append(0, np.cumsum(digit))
    inside = counts[w.ends] - counts[w.starts] if len(w.starts) else np.zeros(0)
    masked = (inside > 0) & (inside < w.ends - w.starts)
    words = np.maximum(n, 1)
    return np.stack([
        100 * sums(np.where(hit, best, 0)) / words, sums(hit), most(word), most(begin), 100 * sums(hit) / words,
        sums(hit & near), 100 * sums(you) / words, upper / letters, 100 * loud / size, 100 * signs / size,
        100 * sums(masked) / words, 100 * part(same3) / size, np.log1p(n),
    ], 1)


class Boosted:
    """Logistic gradient boosting with histogram trees of fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.bias)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            node, tree = np.zeros(len(y), np.int64), []
            for depth in range(DEPTH):
                count = 1 << depth
                best = [(1e-9, 0, BINS)] * count  # no split: all go left
                gt, ht = np.bincount(node, g, count), np.bincount(node, h, count)
                for j in range(x.shape[1]):
                    at = node * BINS + bins[:, j]
                    gl = np.bincount(at, g, count * BINS).reshape(count, BINS).cumsum(1)
                    hl = np.bincount(at, h, count * BINS).reshape(count, BINS).cumsum(1)
                    nl = np.bincount(at, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                    gain = gl**2 / (hl + 1) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + 1) - (gt**2 / (ht + 1))[:, None]
                    gain[(nl < LEAF) | (nl[:, -1:] - nl < LEAF)] = 0
                    for i in range(count):
                        k = int(gain[i].argmax())
                        if gain[i, k] > best[i][0]:
                            best[i] = (float(gain[i, k]), j, k)
                split, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                tree.append((split, cut))
                node = node * 2 + (bins[np.arange(len(y)), split[node]] > cut[node])
            leaves = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            self.trees.append((tree, leaves))
            f = f + leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        f, r = np.full(len(x), self.bias), np.arange(len(x))
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for split, cut in tree:
                node = node * 2 + (bins[r, split[node]] > cut[node])
            f += leaves[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step function nearest to y over x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order], y[order].astype(float)):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in [b[0] / b[1]] * 2])


class Model:
    """Lexicon, trees and calibration; `score` gives chances for texts."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray):
        self.lexicon, self.trees = lexicon, None
        self.share = float(y.mean()) if len(y) else 0.0
        if 0 < self.share < 1:
            third = np.arange(len(y)) % 3
            raw = np.zeros(len(y))
            for k in range(3):
                raw[third == k] = Boosted().fit(x[third != k], y[third != k]).raw(x[third == k])
            self.knots = isotonic(raw, y)
            self.trees = Boosted().fit(x, y)

    def score(self, texts: list) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(features(texts, self.lexicon))
        # A trace of the raw score orders documents within a step.
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw))


def _learnt_lexicon(sample: DataFrame) -> Lexicon:
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = sample.mapInArrow(_count_keys, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.1) / (F.col("neg") + 0.6) * ((n - pos + 1) / (pos + 1)))
    top = counts.where(F.col("pos") >= SEEN - 1).withColumn("odds", odds).where("odds >= 1").orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "key").limit(ENTRIES)
    got = top.select("key", "pos", "neg").collect()
    col = lambda c: np.array([r[c] for r in got], np.int64)
    return Lexicon(col("key").view(U), col("pos"), col("neg"), int(pos), int(n - pos))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_size: int = SAMPLE) -> Model:
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, sample_size)
    lexicon = _learnt_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("y").to_numpy()
            for lo, hi in pieces(texts, 1 << 19):
                x = features(texts[lo:hi], lexicon, y[lo:hi])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([flat, pa.array(y[lo:hi])], ["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y int").collect()
    got.sort(key=lambda r: (r["x"], r["y"]))  # the same order on every run
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(got))
    x = np.array([r["x"] for r in got]).reshape(-1, N_FEATURES)[order]
    return Model(lexicon, x, np.array([r["y"] for r in got], float)[order])


def _scored(model: Model, docs: DataFrame, keep_below: float | None, name: str) -> DataFrame:
    """docs with a column `name`; with keep_below only the rows under it, scored and dropped in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in pieces(texts, 1 << 19):
                score = shared.value.score(texts[lo:hi])
                part = b.slice(lo, hi - lo)
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])
                yield out if keep_below is None else out.filter(pa.array(score < keep_below))

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    s = _scored(train(docs, labels), docs.select("doc_id", "text"), None, "score")
    return s.select("doc_id", (F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(-1)) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, columns as they were, whatever their names."""
    name = unused(docs, "score_")
    return _scored(train(docs, labels), docs, threshold, name).drop(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
