"""Stage functions keep columns whose names operators might use inside."""

import pytest
from pyspark.sql import functions as F

from glossa.llm.decontaminate import drop_contaminated
from glossa.llm.mixing import mix_documents
from glossa.llm.near_dedup import deduplicate
from glossa.llm.toxicity import drop_toxic

EXTRA = ["__copy", "__th", "__id", "__nth", "__score", "th_", "ID_", "score_", "draw_", "stays_", "text_", "windows_", "ratio_", "skey_"]


@pytest.fixture
def docs(spark):
    rows = [(i, f"text number {i} has words of its own and some more", f"s{i % 2}") for i in range(30)] + [(40, "one two three four five six", "s0"), (41, "one two three four five six", "s1"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), "source", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in EXTRA))


def same_rows(out, docs):
    assert out.columns == docs.columns
    known = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= known
    return got


def test_stages_keep_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert same_rows(drop_toxic(docs, labels), docs)
    assert sorted(r[0] for r in same_rows(deduplicate(docs), docs) if r[0] is not None) == [*range(30), 40]
    assert len(same_rows(drop_contaminated(docs, bench), docs)) == 31
    assert same_rows(mix_documents(docs), docs)


def test_groups_of_null_and_repeated_ids_keep_one_row(spark):
    """Texts that are near copies under one id, under none, and rows alike in everything: one row of each group."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base), (7, base + " more"), (7, base), (None, "x " + base[3:] + " q" * 9), (None, "other words of no id at all here"), (None, "other words of no id at all here"), (9, None), (9, None)]
    for limit in (400_000, 0):
        import glossa.llm.near_dedup as nd

        before, nd.BROADCAST_ROWS = nd.BROADCAST_ROWS, limit
        try:
            got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        finally:
            nd.BROADCAST_ROWS = before
        kept = [r for r in got if r["text"]]
        assert sum(r["doc_id"] == 7 for r in kept) == 1 and sum(r["text"].startswith("other") for r in kept) == 1
        assert sum(r["text"] is None for r in got) == 2
