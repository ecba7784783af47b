"""Vectorised words, hashes and k-grams over batches of texts, in numpy.

A batch of texts becomes one buffer of UTF-8 bytes; words are runs of word bytes, so
nothing is done for each word in Python.  Hashes are polynomial prefix sums modulo
2^64 over random byte values, finished by a mixing function: a word's or k-gram's hash
depends on its content alone, on no process and no batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SLAB = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_POWERS = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}

#: Bytes that belong to words: everything but ASCII white space, or letters and digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64; kept and doubled as needed."""
    p = _POWERS[base]
    with np.errstate(over="ignore"):
        while len(p) < n:
            p = np.concatenate([p, p * p[-1] * U(base)])
    _POWERS[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), in a new array."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of values[starts:ends] for each pair; values are uint64."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(BASE, n), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


class Words:
    """Words of a batch of texts: hash, byte span and document of each, in order.

    first: where each document's words begin, with the total at the end.
    """

    def __init__(self, texts: list, word_bytes: np.ndarray, lower: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b"\n".join(raw) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        self.data = LOWER[data] if lower else data
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.doc_end = np.cumsum(lengths + 1) - 1
        self.doc_start = self.doc_end - lengths
        inside = word_bytes[self.data]
        inside[self.doc_end] = False
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = np.empty(len(self.starts), U)
        i = 0
        while i < len(self.starts):  # some bytes at a time: eight bytes are needed for each
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + SLAB, "right")))
            self.hashes[i:j] = span_hashes(BYTE_VALUES[self.data[base : self.ends[j - 1]]], self.starts[i:j] - base, self.ends[i:j] - base)
            i = j
        self.first = np.append(np.searchsorted(self.starts, self.doc_start), len(self.starts)).astype(np.int64)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.n)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-grams of words within documents, and the word index at which each begins."""
        n = len(self.hashes)
        at = np.arange(n)
        at = at[at + k <= self.first[self.doc + 1]] if n else at
        return (span_hashes(self.hashes, at, at + k) if len(at) else np.zeros(0, U)), at


def pieces(batch: list, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of `batch` of about `limit` characters each, at least one text each."""
    start = size = 0
    for i, t in enumerate(batch):
        if size and size + len(t or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(t or "") + 1
    if start < len(batch):
        yield start, len(batch)


def runs_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w, by doubling; len(values) - w + 1 of them."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
