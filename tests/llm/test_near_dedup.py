import random
import re

import numpy as np
import pytest

from glossa.llm import near_dedup
from glossa.llm.components import components
from tests.llm.conftest import DOCS, make_docs


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if sets[i] and d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i), d) if sets[i] else d) for i, (d, *_) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def families():
    """Copies edited more and more: pairs on both sides of the threshold, chains, and one large family."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 1000
    for size, edits, length in ((2, 1, 30), (3, 3, 80), (6, 6, 200), (4, 1, 8), (250, 5, 150), (40, 0, 60)):
        base = [rnd.choice(words) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(length)] = rnd.choice(words)
            rows.append((n, " ".join(w), "s"))
            n += 1
    chain = [rnd.choice(words) for _ in range(100)]
    for k in range(8):
        rows.append((n + k, " ".join(chain[3 * k :] + [rnd.choice(words) for _ in range(3 * k)]), "s"))
    return rows


def test_components_are_the_true_ones(spark, corpus, families, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    rows = [r for r in corpus if r[0] != 104] + families
    got = near_dedup.find_near_duplicates(make_docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    kept = near_dedup.deduplicate(make_docs(spark, rows))
    want = {c for d, n, c in brute(rows) if n}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and shingles(r["text"])) == sorted(want)
    assert kept.columns == DOCS.replace(",", "").split()[::2] and kept.where("text IS NULL OR trim(text) = ''").count() >= 2


def test_open_buckets_alone_find_the_links(spark, families, monkeypatch):
    """Without stars around drawn members the exact comparison has to do it."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    rows = families[11:120]
    got = near_dedup.find_near_duplicates(make_docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    both = np.unique(np.concatenate([a, b]))
    ra, rb, rab = (near_dedup.registers(x, np.array([0]))[0] for x in (a, b, both))
    assert (np.maximum(ra, rb) == rab).all()
    half = np.concatenate([a[:600], b[:300]])
    assert abs((near_dedup.registers(half, np.array([0]))[0] == ra).mean() - 0.5) < 0.15
    assert near_dedup.plausible(np.array([900]), np.array([900]), ra[None], ra[None])[0] and not near_dedup.plausible(np.array([900]), np.array([900]), ra[None], rb[None])[0]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(45)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: x for v, x in label.items() if v in linked}


def test_empty(spark):
    assert near_dedup.find_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
