"""Words with offsets on odd texts, and what their plan must not do for each word."""

import re

import pytest
from pyspark.sql import functions as F

from glossa.operators import suggest as module
from glossa.operators.suggest import protected_spans, tokens
from glossa.plans import tables

TEXTS = [None, "", " ", "a", "ab `cd ef` gh", "\x01a\x01 b\x01", "É 𝒳y `𝒳` z", "see https://x.y/a_b c", "```a\nb``` `c", "`a` " * 300, "no code, at all", "    all of it\n\tindented"]


@pytest.mark.parametrize("protected", [None, True, False])
@pytest.mark.parametrize("ident", ["bigint", "string"])
def test_words_of_odd_texts(spark, monkeypatch, protected, ident):
    monkeypatch.setattr(module, "ROWS", 7)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1).withColumn("doc_id", F.col("doc_id").cast(ident))
    spans = {r[0]: r[1] for r in docs.select("doc_id", protected_spans(F.col("text"))).collect()}
    expected = []
    for i, text in ((docs.schema["doc_id"].dataType.simpleString() == "string" and str(i) or i, t) for i, t in enumerate(TEXTS)):
        for m in re.finditer(r"\w+", text or ""):
            inside = any(s["start"] < m.end() and s["end"] > m.start() for s in spans[i] or [])
            if protected is None or inside == protected:
                expected.append((i, m.start(), m.end(), m.group()))
    got = tokens(docs, protected)
    assert [f.dataType.simpleString() for f in got.schema] == [ident, "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("protected", [None, True, False])
def test_no_lambda_adds_up_words(spark, protected):
    """A running sum in lambdas took most of the time of every query of words."""
    plan = tokens(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), protected)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_only_words_in_regions_are_joined(spark, monkeypatch):
    seen, join = [], tables.interval_join
    monkeypatch.setattr(tables, "interval_join", lambda left, right, *a, **k: seen.append(left) or join(left, right, *a, **k))
    pairs = tables.protected_pairs(spark, "/root/testdata/sf0.001").select("doc_id", "start").distinct().count()
    assert seen[0].count() == pairs > 0
