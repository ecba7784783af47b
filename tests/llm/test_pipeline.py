from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_mixing, test_near_dedup
from tests.llm.conftest import make_docs

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = [], [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        names.append(name)
        counts.append(docs.count())
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 100 and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture
def folder(spark, corpus, tmp_path):
    """Documents with near copies, benchmark passages, nulls and repeats; no labels, so no document is toxic."""
    base = [f"w{i}" for i in range(80)]
    rows = [r for r in corpus if r[0] != 104]
    rows += [(700 + k, " ".join(base[: 80 - k]), f"s{k % 3}") for k in range(5)] + [(720 + k, f"lead {k} " + " ".join(base[10:40]) + f" tail {k}", "s1") for k in range(4)]
    bench = [(1, " ".join(base[15:30])), (2, "not there at all"), (None, None)]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, bench


def test_stages_against_plain_python(spark, folder):
    path, rows, bench = folder
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    safe = stages["toxicity"](spark, docs, path)
    assert Counter(plain(safe)) == Counter(rows)
    single = stages["near_dedup"](spark, safe, path)
    truth = test_near_dedup.brute(rows)
    got = plain(single)
    ids = {c for _, n, c in truth if n}
    assert sorted(str(i) for i, t, _ in got if t and t.split()) == sorted(str(i) for i in ids)
    assert Counter(t for _, t, _ in got if not (t and t.split())) == Counter(t for _, t, _ in rows if not (t and t.split()))
    clean = stages["decontamination"](spark, single, path)
    dirty = Counter((r[0], r[5]) for r in test_decontaminate.brute(got, bench))
    assert sorted(str(i) for i, *_ in plain(clean)) == sorted(str(i) for (i, bad), n in dirty.items() if not bad for _ in range(n))
    mixed = stages["mixing"](spark, clean, path)
    sizes = defaultdict(int)
    for _, t, s in plain(clean):
        sizes[s] += len((t or "").split())
    want, taken, longest = test_mixing.filled(dict(sizes)), defaultdict(int), max(len((t or "").split()) for _, t, _ in plain(clean))
    for (i, t, s), n in Counter(plain(mixed)).items():
        taken[s] += n * len(t.split())
        assert n <= 3
    assert all(abs(taken[s] - want[s]) <= 0.2 * want[s] + 3 * longest for s in sizes)
    placed = stages["sharding"](spark, mixed, path).collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(i for i, *_ in plain(mixed))
    assert corpus_pipeline.run(spark, path).select("doc_id", "shard", "slot").count() == len(placed)
