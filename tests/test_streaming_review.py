"""Streams of a review against what the batch operators give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from glossa.operators import review
from glossa.streaming.review import decided_stream, keyed_state, remembered_stream

MATCHES = "doc_id long, match_ord int, start long, base string, alternatives array<string>, raws array<string>, line string"
ALTS = ["employ", "apply", "exert"]


def answered(spark, n_docs=6):
    rows = []
    for doc in range(n_docs):
        for i in range(12):
            base = ("use", "help")[(doc + i) % 2]
            raws = ALTS if (doc + i) % 5 else ALTS[1:]
            rows.append((doc, i, 10 * i, base, [r + "s" for r in raws], raws, (str((doc + i // 4 + 1) % 4), "", "", "x")[(doc + 3 * i) % 4]))
    return spark.createDataFrame(rows, MATCHES)


def fed(spark, stream_of, parts, folder, sink="out"):
    """One start of the query for each part, on one checkpoint."""
    for i, part in enumerate(parts):
        for name, df in part.items():
            df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams = {name: spark.readStream.schema(df.schema).parquet(f"{folder}/{name}") for name, df in parts[0].items()}
        q = stream_of(**streams).writeStream.format("parquet").option("path", f"{folder}/{sink}").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        yield i, q


def columns(df):
    return sorted(map(tuple, df.select("doc_id", "match_ord", "default_no", "choice_no").collect()))


def test_many_batches_and_restarts_give_the_batch_replay(spark, tmp_path):
    rows = answered(spark)
    want = columns(review.chosen(review.remembered(review.read_lines(rows))))
    parts = [{"rows": rows.where(F.col("match_ord").between(4 * i, 4 * i + 3))} for i in range(3)]
    with keyed_state(spark):
        assert sum(1 for _ in fed(spark, lambda rows: remembered_stream(rows), parts, str(tmp_path))) == 3
    got = columns(spark.read.parquet(str(tmp_path / "out")))
    assert got == want and any(d is not None for _, _, d, _ in got)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_calls_of_python_are_for_buckets_not_for_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("glossa.streaming.review.BUCKETS", 2)
    rows = answered(spark, 39)
    want = columns(review.chosen(review.remembered(review.read_lines(rows))))
    parts = [{"rows": rows.where("match_ord < 6")}, {"rows": rows.where("match_ord >= 6")}]
    with keyed_state(spark):
        assert sum(1 for _ in fed(spark, lambda rows: remembered_stream(rows), parts, str(tmp_path))) == 2
    assert columns(spark.read.parquet(str(tmp_path / "out"))) == want
    with_key = [n for n in remembered_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows")))._jdf.queryExecution().logical().toString().splitlines() if "TransformWithState" in n]
    assert with_key and all("bucket" in n for n in with_key)


def test_what_is_remembered_expires(spark, tmp_path):
    """Kept for an hour after the answer; state goes with the watermark."""
    one = answered(spark, 1).limit(1).drop("line", "match_ord", "start")

    def at(match, minute, line, doc=0):
        when = F.lit(datetime(2024, 1, 1) + timedelta(minutes=minute)).cast("timestamp")
        return one.withColumn("doc_id", F.lit(doc).cast("long")).withColumn("match_ord", F.lit(match)).withColumn("start", F.lit(match).cast("long")).withColumn("line", F.lit(line)).withColumn("answered_at", when)

    parts = [at(0, 0, "1"), at(1, 59, "").unionByName(at(2, 61, "")), at(3, 70, "2").unionByName(at(4, 100, "")), at(0, 400, "1", doc=7), at(5, 410, "")]
    state = []
    with keyed_state(spark):
        for _, q in fed(spark, lambda rows: remembered_stream(rows, keep_ms=3_600_000), [{"rows": p} for p in parts], str(tmp_path)):
            state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r["doc_id"], r["match_ord"]): r["default_no"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 0): None, (0, 1): 1, (0, 2): None, (0, 3): None, (0, 4): 2, (7, 0): None, (0, 5): None}
    assert state[-1] <= max(state[:3])


def test_late_and_missing_decisions(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    show = lambda rows: spark.createDataFrame([(d, 0, at(m)) for d, m in rows], "doc_id long, match_ord int, shown_at timestamp")
    tell = lambda rows: spark.createDataFrame([(d, 0, line, at(m)) for d, line, m in rows], "doc_id long, match_ord int, line string, decided_at timestamp")
    parts = [
        # 1 in time, 2 never, 3 too long after, 4 before it is shown, 5 at the last moment and 6 in a later batch.
        {"m": show([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 50)]), "d": tell([(1, "1", 5), (4, "2", 2), (5, "3", 64)])},
        {"m": show([(7, 55)]), "d": tell([(3, "1", 63), (6, "2", 70)])},
        {"m": show([(8, 600)]), "d": tell([(9, "1", 600)])},
        # 7 is long past: dropped, and so is the match 10.
        {"m": show([(10, 100), (11, 2000)]), "d": tell([(7, "1", 60), (12, "1", 2000)])},
    ]
    state = []
    for _, q in fed(spark, lambda m, d: decided_stream(m, d), parts, str(tmp_path)):
        state.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    got = sorted((r["doc_id"], r["line"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "1"), (2, None), (3, None), (4, None), (5, "3"), (6, "2"), (7, None), (8, None)]
    assert state[-1] <= 3  # what was shown or decided last


def test_state_of_decisions_is_a_value_for_each_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("glossa.streaming.review.WAITING", 2)
    big = 2**60 + 1
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    show = lambda rows: spark.createDataFrame([(d, 0, at(m)) for d, m in rows], "doc_id long, match_ord int, shown_at timestamp")
    tell = lambda rows: spark.createDataFrame([(d, 0, line, at(m)) for d, line, m in rows], "doc_id long, match_ord int, line string, decided_at timestamp")
    parts = [
        {"m": show([(None, 3), *((big + i, i) for i in range(30))]), "d": tell([(None, "0", 4), (big, "2", 6), *((big + i, "1", i + 5) for i in range(0, 30, 2))])},
        {"m": show([(-1, 5000)]), "d": tell([(-2, "1", 5000)])},
    ]
    state = [q.lastProgress["stateOperators"][0]["numRowsTotal"] for _, q in fed(spark, lambda m, d: decided_stream(m, d), parts, str(tmp_path))]
    got = sorted(((r["doc_id"], r["line"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted([(None, None), (big, "2"), *((big + i, None if i % 2 else "1") for i in range(30))], key=str)
    assert max(state) <= 2
