import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import sharding
from tests.llm.conftest import DOCS, make_docs


def check(rows, got, near):
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in rows)
    text = {i: t or "" for i, t, _ in rows}
    slots, load, place = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        place[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    share = sum(load.values()) / 8
    assert all(abs(load[s] - share) <= near * share for s in range(8))
    return place


def test_shards(spark, corpus):
    rows = corpus + [(1000 + i, f"{t} {k}", s) for k in range(6) for i, (_, t, s) in enumerate(corpus[:60], 60 * k)]
    got = sharding.shard_documents(make_docs(spark, rows)).collect()
    # One text alone is longer than a share; the other shards are level.
    check(rows, got, 9)
    rows = [r for r in rows if r[0] != 104]
    got = sharding.shard_documents(make_docs(spark, rows)).collect()
    assert all(len(s) == 1 for s in check(rows, got, 0.06).values())


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text for all of these", "s") for i in range(3000)] + [(5000 + i, f"text number {i} of its own", "s") for i in range(3000)]
    place = check(rows, sharding.shard_documents(make_docs(spark, rows)).collect(), 0.02)
    assert sum(len(s) > 1 for s in place.values()) == 1
    rows = [(i, None, None) for i in range(400)]
    check(rows, sharding.shard_documents(make_docs(spark, rows)).collect(), 0.02)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7])
def test_a_group_without_ids_of_its_own_is_split(spark, ids):
    """Null and repeated ids spread like others: near equal bytes, gapless slots."""
    rows = [(ids(i), "one text that all of these rows share", "s") for i in range(800)] + [(5000 + i, f"another text, number {i:04} of them", "s") for i in range(800)]
    got = sharding.shard_documents(make_docs(spark, rows)).collect()
    load = defaultdict(int)
    for r in got:
        load[r["shard"]] += r["size"]
    share = sum(load.values()) / 8
    assert len(got) == 1600 and all(abs(load[s] - share) <= 0.02 * share for s in range(8))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(8))


def test_copies_of_many_sources_share_a_shard(spark, monkeypatch):
    """Small groups too stand together, by broadcast and by key, and cut ranges do not part them."""
    rows = [(i, f"text of group {i // 3} in three rows", f"s{i % 5}") for i in range(3000)]
    for wide in (1 << 16, 1):
        monkeypatch.setattr(sharding, "WIDE", wide)
        got = sharding.shard_documents(make_docs(spark, rows)).collect()
        assert all(len(s) == 1 for s in check(rows, got, 0.02).values())


@pytest.mark.parametrize(("bits", "dims"), [(2, 2), (3, 3), (4, 3)])
def test_curve_visits_neighbours(bits, dims):
    cells = [tuple(c >> bits * d & (1 << bits) - 1 for d in range(dims)) for c in range(1 << bits * dims)]
    order = sorted(cells, key=lambda c: sharding.hilbert_index(c, bits))
    assert sorted(sharding.hilbert_index(c, bits) for c in cells) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(order, order[1:]))


def test_curve_column_and_empty(spark):
    got = spark.range(sharding.CELLS).select("id", sharding.curve_of(F.col("id").cast("int")).alias("h")).collect()
    mask = (1 << sharding.BITS) - 1
    assert all(r["h"] == sharding.hilbert_index(tuple(r["id"] >> sharding.BITS * (2 - d) & mask for d in range(3)), sharding.BITS) for r in got)
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_steps_follow_names_and_bytes(spark):
    rows = [("b", 10), (None, 5), ("a", 3), ("é", 40), ("z", 2), ("c", 0)]
    want, before = [], 5
    for v, c in sorted(rows[:1] + rows[2:], key=lambda r: r[0].encode()):
        step = before * 16 // 60
        if step > (want[-1][1] if want else 0):
            want.append((v, step))
        before += c
    df = spark.createDataFrame(rows, "v string, c long")
    steps = sharding._steps(df)
    assert steps == want
    got = dict(df.select("v", sharding._step(F.col("v"), steps).alias("s")).collect())
    assert got == {v: max([n for w, n in want if v is not None and w.encode() <= v.encode()], default=0) for v, _ in rows}


def test_many_names_are_cut_by_their_beginnings(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NAMES", 30)
    df = spark.range(4000).select(F.format_string("site%04d.example", "id").alias("v"), F.lit(1).cast("long").alias("c"))
    steps = sharding._steps(df)
    assert 0 < len(steps) <= 15 and all(len(v) == 5 for v, _ in steps) and [n for _, n in steps] == sorted({n for _, n in steps})
    assert sharding._steps(df.where("false")) == []


def test_slots_follow_the_curve_and_files_have_narrow_ranges(spark):
    """Cuts and slots along the curve; of files of each shard far fewer than of dealt ones may hold a source, language or size."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_documents(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").orderBy("shard", "slot").collect()
    light = [r for r in got if r["curve"] is not None]
    for s in range(8):
        own = [r["curve"] for r in light if r["shard"] == s]
        assert own == sorted(own)
    # Groups that are placed on their own apart, the runs of shards follow each other.
    texts = defaultdict(int)
    for r in got:
        texts[r["text_crc32"]] += 1
    single = [r for r in got if texts[r["text_crc32"]] == 1]
    assert all(a["shard"] <= b["shard"] for a, b in zip(single, single[1:]) if a["curve"] < b["curve"])

    def held(rows):
        files = defaultdict(list)
        for i, r in enumerate(rows):
            files[i // 20].append(r)
        return [sum(min(x[c] for x in f) <= v <= max(x[c] for x in f) for f in files.values() for v in {r[c] for r in rows}) for c in ("lang", "source", "size")]

    dealt = sorted(got, key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    assert all(a < 0.7 * b for a, b in zip(held(got), held(dealt), strict=True)), (held(got), held(dealt))
