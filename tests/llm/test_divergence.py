"""Divergences of sources against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import glossa.llm.divergence as dv

from .conftest import make_docs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    """rows: (lang, source, text) -> {(lang, source, term): [n, docs]}."""
    out = defaultdict(lambda: [0, 0])
    for lang, source, text in rows:
        for term, n in Counter(TERM.findall((text or "").translate(LOW))).items():
            out[lang or "", source or "", term][0] += n
            out[lang or "", source or "", term][1] += 1
    return dict(out)


def plain(rows, least):
    counts, out = plain_counts(rows), []
    groups = defaultdict(set)
    for lang, source, _ in rows:
        groups[lang or ""].add(source or "")
    for lang, sources in groups.items():
        docs, n = Counter(), Counter()
        for (g, _, t), (c, d) in counts.items():
            if g == lang:
                docs[t] += d
                n[t] += c
        kept = [t for t in n if docs[t] >= least]
        share = lambda c, total: 1 + dv.SCALE * (c + dv.ADDED) // (total + dv.ADDED * len(kept))  # noqa: B023, E731
        own = {s: {t: counts.get((lang, s, t), [0])[0] for t in kept} for s in sources}
        p = {s: {t: share(c, sum(own[s].values())) for t, c in own[s].items()} for s in sources}
        q = {t: share(n[t], sum(n[t] for t in kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked) if part == "pair" or i < dv.TOP]
    return sorted(out)


@pytest.mark.parametrize(("cells", "sources", "langs", "least"), [(50_000, 256, 10_000, 3), (40, 2, 0, 2), (7, 1, 10_000, 5)])
def test_against_a_plain_version(spark, corpus, monkeypatch, cells, sources, langs, least):
    for name, value in (("CELLS", cells), ("SOURCES", sources), ("LANGUAGES", langs)):
        monkeypatch.setattr(dv, name, value)
    df = make_docs(spark, corpus)
    rows = [(r["lang"], r["source"], r["text"]) for r in df.collect()]
    got = sorted(map(tuple, dv.divergences(df.repartition(3), least).collect()))
    assert got == plain(rows, least) and any(r[2] == "term" for r in got)


def test_no_term_kept_and_no_rows(spark):
    df = spark.createDataFrame([("a", "x", "one two"), ("a", "y", None), ("b", None, "...")], "lang string, source string, text string")
    got = sorted(map(tuple, dv.divergences(df).collect()))
    assert got == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
    assert dv.divergences(df.where("false")).collect() == []


def counted(texts, groups):
    raw = [t.encode() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    out = defaultdict(lambda: [0, 0])
    for b in dv.TermCounts().of(dv.LOWER[np.frombuffer(b"".join(raw), np.uint8)], first, groups):
        for r in b.to_pylist():
            key = r["lang"], r["source"], r["term"] and r["term"].decode()
            out[key][0] += r["n"]
            out[key][1] += r["docs"]
    return dict(out)


@pytest.mark.parametrize("slab", [1, 5, 64, 1 << 22])
@pytest.mark.parametrize("same_hash", [False, True])
def test_slabs_and_equal_hashes(monkeypatch, slab, same_hash):
    monkeypatch.setattr(dv, "SLAB", slab)
    if same_hash:
        monkeypatch.setattr(dv.xxhash, "xxh3_64_intdigest", lambda b: len(b))
    texts = ["The the cat", "", "cat" * 40, "ünder THE sea, the sea", "end", "endless", "日本 x日本 日本", "a.b.c.a.b", "  ", "last the"] * 2
    groups = [("en", f"s{i % 3}") for i in range(len(texts))]
    want = plain_counts([(*g, t) for g, t in zip(groups, texts, strict=True)])
    assert counted(texts, groups) == want | {("en", f"s{i}", None): [0, 0] for i in range(3)}


def test_offset_batches():
    b = pa.record_batch({"lang": ["a"] * 4, "source": ["s"] * 4, "text": ["skip", "two words", "", "two"]})
    rows = pa.Table.from_batches(dv._count(iter([b.slice(1), b.slice(0, 0)]))).to_pylist()
    assert {r["term"]: (r["n"], r["docs"]) for r in rows} == {b"two": (2, 2), b"words": (1, 1), None: (0, 0)} and len(rows) == 3


def test_pair_sums_and_large_counts():
    rnd = np.random.default_rng(5)
    dense = np.where(rnd.random((6, 30)) < 0.3, rnd.integers(1, 1000, (6, 30)), -1)
    dense[2] = -1
    zero = rnd.integers(1, 50, 6)
    row, col = np.nonzero(dense >= 0)
    ptr = np.searchsorted(row, np.arange(7))
    full = np.where(dense < 0, zero[:, None], dense)
    want = np.abs(full[:, None] - full[None]).sum(2)
    assert (dv.pair_sums(ptr, col, dense[row, col], zero, 30, np.arange(6)) == want).all()
    big = np.array([3 * 10**10, 5])
    assert dv.shares(big, np.array([7 * 10**11] * 2), np.array([9, 9])).tolist() == [1 + 10**9 * (c + 5) // (7 * 10**11 + 45) for c in big.tolist()]
