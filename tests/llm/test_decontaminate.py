import hashlib
import re

import pytest

from glossa.llm import decontaminate
from tests.llm.conftest import DOCS, make_docs

ITEM = "item_id long, text string, hits string"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for i, t, _ in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            k = min(10, len(x))
            grams = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set()
            at = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in grams]
            hit |= {p for j in at for p in range(j, j + k)}
            if at and item is not None:
                ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def items(corpus):
    first, second = corpus[7][1].split(), corpus[8][1].split()
    while len(first) < 60:
        first += corpus[11][1].split()
    some = [(1, " ".join(first[:25])), (12, " ".join(first[3:18]).upper()), (3, " ".join(second[:3])), (4, None), (5, ""), (6, "!!"), (7, "alone together"), (12, " ".join(first[3:18])), (None, "null item words")]
    return some, [(300, "Before: " + ", ".join(first[2:30]) + " after", "s0"), (301, "so alone  together x " * 3, "s0"), (302, " ".join(first[:9]), "s0"), (303, "null item words", "s1"), (304, " ".join(first[5:16] * 4), "s0")]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_all_windows(spark, corpus, items, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    rows = corpus + items[1]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items[0]], ITEM)
    monkeypatch.setattr(decontaminate, "LOOKUP_WINDOWS", limit)
    got = decontaminate.find_overlaps(make_docs(spark, rows), bench).collect()
    want = brute(rows, items[0])
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r[-1] for r in want) >= 5
    kept = decontaminate.drop_contaminated(make_docs(spark, rows), bench)
    assert kept.count() == sum(not r[-1] for r in want) and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], ITEM)
    docs = make_docs(spark, corpus)
    assert {r["contaminated"] for r in decontaminate.find_overlaps(docs, none).collect()} == {False}
    assert decontaminate.find_overlaps(spark.createDataFrame([], DOCS), none).count() == 0


def test_picks_are_the_least_of_each_window():
    """Against a walk over every window; any shared window has the same pick in both texts."""
    import random

    import numpy as np

    from glossa.llm.textkit import ALNUM, Words

    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcde") for _ in range(n)) for n in (0, 5, 9, 10, 11, 40, 300)]
    w = Words(texts, ALNUM)
    fp, at = decontaminate.picks(w)
    grams, where = w.grams(decontaminate.K)
    hash_at = dict(zip(where.tolist(), grams.tolist()))
    want = set()
    for d in range(len(texts)):
        for i in range(int(w.first[d]), int(w.first[d + 1]) - decontaminate.WINDOW + 1):
            want.add(min(range(i, i + decontaminate.GRAMS), key=lambda j: (hash_at[j], -j)))
    assert at.tolist() == sorted(want) and fp.tolist() == [hash_at[i] for i in sorted(want)]
    own, starts, wh = decontaminate.around(w, fp, at)
    assert {i for d in range(len(texts)) for i in range(int(w.first[d]), int(w.first[d + 1]) - 9)} == set(np.unique(starts).tolist())
