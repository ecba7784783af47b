from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm.mixing import mix_documents, mixture, permuted
from tests.llm.conftest import DOCS, make_docs


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Targets by plain repetition: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def test_targets_and_takes(spark, corpus):
    docs = make_docs(spark, corpus)
    got = mixture(docs).collect()
    assert len(got) == len(corpus)
    sizes = defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len((t or "").split())
    want = filled(sizes)
    taken = defaultdict(int)
    for r in got:
        source = None if r["skey"] == "n" else r["skey"][1:]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixture(docs.repartition(7)).collect()))


def test_caps(spark):
    rows = [(i, "a b c d", "big") for i in range(50)] + [(90, "x y", "a"), (91, "z", "c"), (92, None, "d")]
    got = {r["skey"]: r["target"] for r in mixture(make_docs(spark, rows)).collect()}
    want = filled({"big": 200, "a": 2, "c": 1, "d": 0})
    assert got == {f"s{s}": pytest.approx(v) for s, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1001])
def test_permutation(spark, n):
    got = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(0))).collect()
    assert sorted(r[0] for r in got) == list(range(n))


def test_empty_and_documents(spark, corpus):
    assert mixture(spark.createDataFrame([], DOCS)).count() == 0
    docs = make_docs(spark, corpus)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert counts and max(counts.values()) <= 9  # three times, for a row that is there three times


def test_documents_do_not_depend_on_partitions(spark, corpus, monkeypatch):
    """The same rows from the same rows in other partitions, also of repeated ones, ids that are null and columns of other kinds; repeated rows near their share."""
    import glossa.llm.mixing as mixing

    rows = corpus + [(None, "a text without an id", "s1")] * 50 + [(8000, "a text and id of many rows", "s3")] * 77 + [(None, None, "s1")] * 5
    docs = make_docs(spark, rows).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    shown = lambda df: Counter(map(str, df.collect()))
    want = shown(mix_documents(docs))
    assert shown(mix_documents(docs.repartition(7))) == want
    monkeypatch.setattr(mixing, "PIECE", 3)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert shown(mix_documents(docs.repartition(5, "n_chars"))) == want
    share = {(r["doc_id"], r["th"]): (r["n"], r["of"]) for r in mixture(docs).groupBy("doc_id", "th").agg(F.sum("taken").alias("n"), F.sum("size").alias("of")).collect()}
    got = mix_documents(docs).withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).groupBy("doc_id", "th").count().collect()
    count = {(r["doc_id"], r["th"]): r["count"] for r in got}
    there = Counter((r["doc_id"], r["th"]) for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect())
    for k, (n, of) in share.items():
        assert abs(count.get(k, 0) - there[k] * n / max(1, of)) < 3, k
