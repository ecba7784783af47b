"""Token counts of byte-level BPE vocabularies by finite-state transducers.

The vocabulary's pre-tokenizer is compiled to a deterministic transducer over classes of
code points: a transition says where a piece of text ends.  A batch of texts is cut
into chunks of equal length; each chunk's map from entry state to exit state is
worked out for all states at once, the maps are composed by a parallel prefix scan,
and a second pass with the known entry states marks the pieces.  The transition that
closes a piece is annotated with the number of tokens that the piece emits; these
counts are compiled on demand from the merge table, for all new pieces of a batch at
once, and kept (by 64-bit content hash) up to KEPT pieces.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of any
length is processed whole; strings of added tokens inside a text are one token each,
as is the library's default; repeated rows are counted alike; an empty table gives
an empty result; extra columns are ignored.  Only plain byte-level BPE vocabularies in
tokenizer JSON files are counted; other vocabulary files fail with an error.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import BYTE_VALUES, U, pieces, span_hashes

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
CHUNK, KEPT = 256, 1 << 20
#: Pieces of more bytes than this are merged one by one.
WIDE = 64
NONE = np.int32(np.iinfo(np.int32).max)

# Classes of code points.  The contraction letters have classes of their own.
LETTER, STMD, RV, LL, EE, NUMBER, BLANK, SPACE, QUOTE, OTHER, END = range(11)
# States: at a text's beginning; within letters, digits, others; after a blank, another white space;
# after a quote that begins a piece; after 'r or 'v; after 'l; after a whole contraction.
BEGIN, IN_L, IN_N, IN_O, AT_BLANK, AT_SPACE, AT_QUOTE, QUOTE_RV, QUOTE_L, DONE = range(10)
# What a transition marks: a piece begins at this code point, or at the one before.
HERE, BACK = 1, 2


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by [state, class]."""
    to, marks = np.zeros((10, 11), np.uint8), np.zeros((10, 11), np.uint8)
    run = {LETTER: IN_L, STMD: IN_L, RV: IN_L, LL: IN_L, EE: IN_L, NUMBER: IN_N, QUOTE: IN_O, OTHER: IN_O}
    white = {BLANK: AT_BLANK, SPACE: AT_SPACE}
    for s in range(10):
        for c in range(11):
            mark = HERE
            if c == END:
                nxt = BEGIN
            elif c in white:
                nxt = white[c]
                if s in (AT_BLANK, AT_SPACE):
                    mark = 0  # white space goes on
            else:
                nxt = AT_QUOTE if c == QUOTE and s not in (IN_O, AT_BLANK, AT_QUOTE) else run[c]
                if s == AT_BLANK:
                    mark = BACK  # the last blank belongs to what follows
                elif s == AT_SPACE:
                    mark = BACK | HERE
                elif (s, nxt) in ((IN_L, IN_L), (IN_N, IN_N), (IN_O, IN_O), (AT_QUOTE, IN_O)):
                    mark = 0
                if s == AT_QUOTE and c in (STMD, RV, LL):
                    nxt, mark = {STMD: DONE, RV: QUOTE_RV, LL: QUOTE_L}[c], 0
            if s in (QUOTE_RV, QUOTE_L):
                if (s, c) in ((QUOTE_RV, EE), (QUOTE_L, LL)):
                    nxt, mark = DONE, 0
                else:  # no contraction: the letters began one earlier
                    mark = BACK | (0 if nxt == IN_L else HERE)
            to[s, c], marks[s, c] = nxt, mark
    return to, marks


TO, MARKS = transducer()


def chunk_states(classes: np.ndarray) -> np.ndarray:
    """State before each code point of one stream, by chunk maps and a prefix scan of their composition."""
    n = len(classes)
    grid = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
    flat, width = TO.ravel(), TO.shape[1]
    maps = np.tile(np.arange(len(TO), dtype=np.uint8), (grid.shape[1], 1))
    for column in grid:
        maps = flat[maps * np.uint8(width) + column[:, None]]
    step = 1
    while step < len(maps):  # inclusive scan: maps[i] becomes the map of chunks 0 to i
        later = maps.copy()
        later[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps, step = later, step * 2
    state = np.append(np.uint8(BEGIN), maps[:-1, BEGIN])
    before = np.empty(grid.shape, np.uint8)
    for i, column in enumerate(grid):
        before[i] = state
        state = flat[state * np.uint8(width) + column]
    return before.T.reshape(-1)[:n]


class Counter:
    """Token counts of texts for one vocabulary; holds the compiled tables and the pieces met so far."""

    def __init__(self, classes: np.ndarray, byte_ids: np.ndarray, pair_keys: np.ndarray, pair_ranks: np.ndarray, pair_ids: np.ndarray, added: list[str], size: int):
        self.classes, self.byte_ids, self.size = classes, byte_ids, np.int64(size)
        self.pair_keys, self.pair_ranks, self.pair_ids = pair_keys, pair_ranks, pair_ids
        self.added = re.compile("|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        self.known, self.counts = np.zeros(0, U), np.zeros(0, np.int32)

    def __getstate__(self):
        return self.__dict__ | {"known": np.zeros(0, U), "counts": np.zeros(0, np.int32)}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left < 0) | (right < 0), np.int64(-1), left * self.size + right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Tokens left in each row of ids (padded by -1) after all merges, lowest rank and leftmost first."""
        out = (ids >= 0).sum(1).astype(np.int32)
        rows = np.arange(len(ids))
        if ids.shape[1] < 2:
            return out
        ranks, merged = self._pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            r = np.arange(len(rows))
            go = ranks[r, at] < NONE
            if not go.all():
                rows, ids, ranks, merged, at = rows[go], ids[go], ranks[go], merged[go], at[go]
                r = np.arange(len(rows))
                if not len(rows):
                    break
            out[rows] -= 1
            ids[r, at] = merged[r, at]
            n = ids.shape[1]
            take = np.arange(n - 1)[None] + (np.arange(n - 1)[None] > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            if n - 2 < 1:
                break
            ranks, merged = (np.take_along_axis(x, np.minimum(take[:, :-1], n - 2), 1) for x in (ranks, merged))
            for p in (at - 1, at):
                ok = (p >= 0) & (p < n - 2)
                q = p[ok]
                ranks[r[ok], q], merged[r[ok], q] = self._pairs(ids[r[ok], q], ids[r[ok], q + 1])
        return out

    def _merge_long(self, piece: np.ndarray) -> int:
        """The same for one long piece, by a heap of pairs over a linked list."""
        ids = self.byte_ids[piece].astype(np.int64).tolist()
        n = len(ids)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        table = self.table()
        heap = [(*table[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] * int(self.size) + ids[i + 1]) in table]
        heapq.heapify(heap)
        left = n
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            left -= 1
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (k := ids[x] * int(self.size) + ids[y]) in table:
                    heapq.heappush(heap, (*table[k], x, ids[x], ids[y]))
        return left

    def table(self) -> dict[int, tuple[int, int]]:
        if "_table" not in self.__dict__:
            self._table = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_ids.tolist())))
        return self._table

    def piece_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of data[start:end] for each piece."""
        hashes = span_hashes(BYTE_VALUES[data], starts, ends)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.zeros(len(keys), np.int32)
        at = np.searchsorted(self.known, keys)
        met = at < len(self.known)
        met[met] = self.known[at[met]] == keys[met]
        counts[met] = self.counts[at[met]]
        new = np.flatnonzero(~met)
        s, size = starts[first[new]], ends[first[new]] - starts[first[new]]
        lo = 0
        for hi in (1, 2, 4, 6, 8, 12, 16, 24, 32, WIDE):
            some = np.flatnonzero((size > lo) & (size <= hi))
            for part in np.array_split(some, max(1, len(some) // 20_000)):
                if len(part):
                    at = s[part, None] + np.arange(hi)
                    ids = np.where(np.arange(hi) < size[part, None], self.byte_ids[data[np.minimum(at, len(data) - 1)]], -1).astype(np.int64)
                    counts[new[part]] = self._merge(ids)
            lo = hi
        for i in np.flatnonzero(size > WIDE):
            counts[new[i]] = self._merge_long(data[s[i] : s[i] + size[i]])
        if len(self.known) + len(new) > KEPT:
            self.known, self.counts = np.zeros(0, U), np.zeros(0, np.int32)
        if len(new) <= KEPT:
            at = np.searchsorted(self.known, keys[new])
            self.known, self.counts = np.insert(self.known, at, keys[new]), np.insert(self.counts, at, counts[new])
        return counts[back]

    def count(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        parts, owner, tokens = [], [], np.zeros(len(texts), np.int64)
        n_bytes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts), np.int64, len(texts))
        for i, t in enumerate(texts):
            cut = self.added.split(t) if t and self.added and self.added.search(t) else [t or ""]
            tokens[i] += len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        stop = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
        classes[stop] = END
        marks = MARKS[chunk_states(classes), classes]
        begins = (marks & HERE) > 0
        begins[:-1] |= (marks[1:] & BACK) > 0
        at = np.flatnonzero(begins)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.append(0, np.cumsum(width, dtype=np.int64))
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        real = classes[at] != END
        starts, ends = offset[at], offset[np.append(at[1:], len(points))]
        starts, ends, at = starts[real], ends[real], at[real]
        if len(at):
            emitted = self.piece_counts(data, starts, ends)
            tokens += np.bincount(np.asarray(owner)[np.searchsorted(stop, at)], emitted, len(texts)).astype(np.int64)
        return n_bytes, tokens


def _probed_classes(tokenizer) -> np.ndarray:
    """Classes of all code points as the library's own pre-tokenizer has them.

    Each code point is put after a letter, a digit and a sign; it has the class of the one that it
    joins.  Planes without assigned characters are 'other'.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    probe = tokenizer.pre_tokenizer
    blocks = [*range(0, 0x40000, 0x2000), 0xE0000]
    for lo in blocks:
        points = [p for p in range(lo, lo + 0x2000) if not 0xD800 <= p < 0xE000 and p]
        text = "".join(f"a{chr(p)}\n1{chr(p)}\n!{chr(p)}\n" for p in points)
        begins = np.zeros(len(text) + 1, bool)
        begins[[span[0] for _, span in probe.pre_tokenize_str(text)]] = True
        joined = ~begins[1 : 9 * len(points) : 3].reshape(-1, 3)
        kind = np.where(joined[:, 0], LETTER, np.where(joined[:, 1], NUMBER, np.where(joined[:, 2], OTHER, SPACE)))
        out[points] = kind
    for chars, c in ((" ", BLANK), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", LL), ("e", EE)):
        out[[ord(x) for x in chars]] = c
    return out


def _alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def compile_vocabulary(path: str) -> Counter:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or not pre.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    vocab = model["vocab"]
    byte_ids = np.zeros(256, np.int32)
    for ch, b in _alphabet().items():
        byte_ids[b] = vocab[ch]
    size = max(vocab.values()) + 1
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    ids = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    return Counter(_probed_classes(Tokenizer.from_file(path)), byte_ids, keys[order], order.astype(np.int32), ids[order], [t["content"] for t in spec["added_tokens"]], size)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(compile_vocabulary(path))  # a few MB, by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in pieces(texts, 1 << 20):
                n_bytes, tokens = counter.count(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {doc_type}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
