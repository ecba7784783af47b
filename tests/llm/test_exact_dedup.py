"""Exact duplicates against a plain version."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import glossa.llm.exact_dedup as ed

from .conftest import make_docs


def plain(rows):
    """(doc_id, text) of each row -> sorted (doc_id, keep_id, size, sha256), and the number of rows that stay of each text."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


def check(spark, rows):
    docs = make_docs(spark, [(i, t, "s") for i, t in rows]).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    got = ed.exact_duplicates(docs.repartition(3), ("doc_id", "sha", "key")).collect()
    want, texts = plain(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["sha"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == texts == len({r["sha"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_corpus(spark, corpus):
    check(spark, [(i, t) for i, t, _ in corpus])


@pytest.mark.parametrize("wide", [0, 1, 10_000])
def test_hot_text_null_ids_and_same_beginnings(spark, wide, monkeypatch):
    monkeypatch.setattr(ed, "WIDE", wide)
    start = "same beginning " * 40
    rows = [(i, "hot") for i in range(120)] + [(None, "only null ids")] * 3 + [(None, "hot")] + [(5, "twice"), (5, "twice"), (None, None), (1, ""), (2, None)]
    rows += [(300 + i, f"{start}{i % 7}") for i in range(20)] + [(400 + i, chr(97 + i) * 50) for i in range(9)] + [(500, "é" * 25), (501, "e" * 50)]
    check(spark, rows)


def test_full_bitmap_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(ed, "BITS_A_GROUP", 0)
    check(spark, [(i, f"text {i % 50}") for i in range(90)])
    assert ed.exact_duplicates(make_docs(spark, [])).collect() == []


def test_normalised_texts_and_names_of_results(spark):
    docs = spark.createDataFrame([(1, "A b", 7, "x"), (2, "a B", 8, "y"), (3, "c", 9, "z")], "doc_id long, text string, kept int, row string")
    got = sorted(map(tuple, ed.exact_duplicates(docs, docs.columns, F.lower).select("doc_id", "text", "row", "keep_id", "kept").collect()))
    assert got == [(1, "A b", "x", 2, False), (2, "a B", "y", 2, True), (3, "c", "z", 3, True)]


def test_texts_are_not_shuffled(spark, tmp_path):
    make_docs(spark, [(i, f"text {i % 50}", "s") for i in range(90)]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = ed.surviving_groups(docs, F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEval" not in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line
