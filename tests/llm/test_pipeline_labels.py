"""Pipeline stages with labels of both kinds: toxic documents go, clean ones stay, and shards follow the curve."""

from collections import defaultdict

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, dict(corpus_pipeline.STAGES)


def test_toxic_documents_go_and_clean_ones_stay(spark, staged):
    """On the largest table: the smaller ones have some fifty toxic labels, too few to learn from."""
    large, (_, stages) = "/root/testdata/sf0.1", staged
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["toxicity"](spark, spark.read.parquet(f"{large}/documents.parquet"), large).collect()}
    toxic, clean = [i for i, t in labels.items() if t], [i for i, t in labels.items() if not t]
    assert len(toxic) > 10 and sum(i in kept for i in toxic) <= 0.15 * len(toxic)
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_slots_of_the_last_stage(spark, staged):
    docs, stages = staged
    rows = stages["sharding"](spark, docs, SF).collect()
    slots, load = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append((r["slot"], r["curve"]))
        load[r["shard"]] += r["size"]
    assert len(rows) == docs.count()
    for own in slots.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        assert [c for _, c in sorted(own)] == sorted(c for _, c in own)
    share = sum(load.values()) / 8
    assert all(abs(n - share) < 0.1 * share for n in load.values())


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_kind(spark, toxic):
    docs = spark.createDataFrame([(i, f"plain words number {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, toxic) for i in range(30)], "doc_id long, quality int, toxic int")
    from glossa.llm.toxicity import drop_toxic, score_toxicity

    assert {r["score"] for r in score_toxicity(docs, labels).collect()} == {float(toxic)}
    assert drop_toxic(docs, labels).count() == (0 if toxic else 30)
