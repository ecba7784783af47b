"""Toxicity and quality on separable invented documents; training never sees the held-out fold."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from glossa.llm import quality, toxicity
from glossa.llm.textkit import SPACED, Words
from tests.llm.conftest import DOCS, make_docs

LABEL = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abdeiklmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(700):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        toxic, good = int(i % 6 == 0), int(i % 5 != 2)
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["frumpous", "m1mblewit", "Snark" + rnd.choice(words)]))
        text = " ".join(w if good else [x + rnd.choice(["###", "%%%", "!!"]) for x in w])
        rows.append((i, text, "s"))
        labels.append((i, good, toxic, "clash"))
    labels += [(None, 1, 1, None), (3, None, None, None), (9999, 1, 0, None), (0, 0, 1, None)]
    return rows, labels


def test_toxicity(spark, labelled):
    rows, labels = labelled
    extra = [(1000, None, "s"), (1001, "", "s"), (1002, "you " * 30_000, "s"), (None, "null id", "s")]
    docs = make_docs(spark, rows + extra + rows[:1])
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, LABEL)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r["doc_id"] for r in got if r["held_out"]} - {1000, 1001, 1002} == held
    truth = {i: t for i, _, t, _ in labels if i is not None}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in held]
    assert np.mean(right) > 0.97
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, LABEL))
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)


def test_quality(spark, labelled):
    rows, labels = labelled
    docs = make_docs(spark, rows + [(1000, None, "s"), (1001, "", "s"), (1002, "word " * 30_000, "s")])
    got = quality.score_quality(docs, spark.createDataFrame(labels, LABEL)).collect()
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: q for i, q, _, _ in labels if q is not None}
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in held]) > 0.97


def test_without_labels(spark, labelled):
    docs, none = make_docs(spark, labelled[0][:5]), spark.createDataFrame([], LABEL)
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_sum_of_squares_identity(labelled):
    """The score against all pairs of distinct features, counted without the module's own inputs; words repeat."""
    rows, labels = labelled
    texts = [f"{t} {t} tail tail tail" for _, t, _ in rows[:80]]
    first, idx, x, stats = quality.inputs(texts)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 7)[1:-1])) for c in stats.T]
    y = np.array([q for _, q, _, _ in labels[:80]], float)
    m = quality.Machine(float(y.mean()), edges).fit([(idx[a:b], x[a:b]) for a, b in zip(first, first[1:])], stats, y)
    for k in (3, 40):
        words = texts[k].split()
        bucket = {t: int(Words([t], SPACED).hashes[0]) >> 64 - 13 for t in set(words)}
        counts = Counter(bucket[t] for t in words)
        features = [(b, c / len(words)) for b, c in counts.items()] + [(b, quality.N_STATS**-0.5) for b in m.bins(stats)[k]]
        f = m.bias + sum(m.w[b] * z for b, z in features)
        f += sum(float(m.v[a].astype(float) @ m.v[b].astype(float)) * u * z for i, (a, u) in enumerate(features) for b, z in features[i + 1 :])
        assert m.score(texts)[k] == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-5)


def test_trees_by_hand():
    """Scores of the boosted trees are those of walking each tree row by row, and fit what they are fitted on."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    b = toxicity.Boosted().fit(x, y)
    raw = b.raw(x)
    for i in range(0, 600, 29):
        f = b.bias
        for tree, leaves in b.trees:
            node = 0
            for split, cut in tree:
                j = split[node]
                bins = sum(1 for e in b.edges[j] if e < x[i, j])
                node = 2 * node + (bins > cut[node])
            f += leaves[node]
        assert raw[i] == pytest.approx(f)
    assert ((raw > 0) == (y == 1)).mean() > 0.97


def test_lexicon_counts_by_hand():
    """Documents by label for every word and beginning, each document once."""
    import pyarrow as pa

    texts, y = ["bad badly bad", "good word", None, "b4d words"], [1, 0, 0, 1]
    got = list(toxicity._count_keys(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(y, pa.int32())], ["text", "y"])])))
    counts = {(r["key"], r["pos"], r["neg"]) for b in got for r in b.to_pylist()}
    key = lambda t: int(np.array(Words([t], toxicity._WORD).hashes).view(np.int64)[0])
    assert {(key("bad"), 2, 0), (key("badly"), 1, 0), (key("good"), 0, 1), (key("word"), 0, 1), (key("words"), 1, 0)} <= counts
    start = key("word")  # 'words' begins with it, under a key of its own
    assert sum(1 for k, *_ in counts if k == start) == 1


def test_labels_of_absent_documents_take_no_room(spark, labelled):
    from glossa.llm.labelled import labelled_sample

    rows, _ = labelled
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(100_000, 100_300)] + [(i, 1, 0, "x") for i, *_ in rows[:30]], LABEL)
    assert labelled_sample(make_docs(spark, rows), labels, "quality", 5, 9, 30).count() == 30


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * x))).astype(float)
    xs, ys = toxicity.isotonic(x, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert np.interp(x, xs, ys).mean() == pytest.approx(y.mean())
