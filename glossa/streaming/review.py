"""A review as a stream: remembered defaults kept between micro-batches, and decisions that come late or never."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import micros
from ..operators.review import chosen, picked, read_lines, with_default

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SHOWN = "doc_id bigint, match_ord int, start bigint, base string, alternatives array<string>, raws array<string>, entered string, number int, valid boolean"

#: Buckets of documents that state is kept by; a checkpoint's stay as they are.
BUCKETS = 2048
#: Buckets of matches that wait for decisions; a checkpoint's stay as they are.
WAITING = 256


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While queries are started in this block, their state is kept in RocksDB, which `remembered_stream` needs; later queries keep what was set."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Remembered(StatefulProcessor):
    """For each base in each document of a bucket, the raw alternative picked last, and when.

    The bucket's records are one value, read and written once for what a micro-batch has of it.
    """

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms, self.schema = keep_ms, "held array<struct<doc:string,base:string,raw:string,at:bigint>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.records = handle, handle.getValueState("last", self.schema)

    def _get(self) -> dict[tuple, tuple[str, int]]:
        had = self.records.get()
        return {(doc, base): (raw, at) for doc, base, raw, at in had[0]} if had else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._get()
        df = pd.concat(list(rows)).sort_values("start")
        out, latest = [], None
        for *of, picked, at in zip(df["doc"], df["base"], df["picked"], df["at"], strict=True):
            of, at = tuple(of), int(at)
            raw, since = held.get(of, (None, 0))
            out.append(None if self.keep_ms is not None and at - since > self.keep_ms else raw)
            if not pd.isna(picked):
                held[of], latest = (picked, at), at if latest is None else max(at, latest)
        if latest is not None:
            self._put(held)
            if self.keep_ms is not None:
                self.handle.registerTimer(latest + self.keep_ms)
        yield df.assign(remembered=pd.Series(out, index=df.index, dtype=object)).drop(columns=["bucket", "doc", "picked", "at"])

    def _put(self, held: dict[tuple, tuple[str, int]]) -> None:
        self.records.update(([(*of, *last) for of, last in held.items()],)) if held else self.records.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._put({of: last for of, last in self._get().items() if last[1] + self.keep_ms > now})
        return iter(())

    def close(self) -> None:
        pass


def remembered_stream(answered: DataFrame, keep_ms: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Matches with `remembered`, `default_no` and `choice_no`, as their answers arrive.

    answered: a stream of matches (doc_id, match_ord, start, base, alternatives, raws), each with the `line` that
    answers it and, with keep_ms, the time `answered_at`.  State is one word for each base of each document, in one
    value for each bucket of documents: a call of Python for each base of each document would take most of the time.  With
    keep_ms a word is remembered for so long after its answer, its state goes when the stream has moved past
    that by `lateness`, and what arrives later than the lateness is dropped; without, it is kept for good.  The
    matches of a document and base must arrive in order of micro-batches; within one they are put in
    order, in one task's memory: a group is what a micro-batch has of one of BUCKETS buckets.
    """
    if keep_ms is not None:
        answered = answered.withWatermark("answered_at", lateness)
    at = F.lit(0).cast("long") if keep_ms is None else F.unix_millis("answered_at")
    shown = read_lines(answered.withColumn("match_ord", F.col("match_ord").cast("int"))).withColumn("picked", picked()).withColumn("at", at)
    shown = shown.select(*(c.split()[0] for c in _SHOWN.split(", ")), "picked", "at", *([] if keep_ms is None else ["answered_at"]))
    out = f"{_SHOWN}, remembered string" + ("" if keep_ms is None else ", answered_at timestamp")
    mode = "none" if keep_ms is None else "EventTime"
    ident = shown.schema["doc_id"].dataType.simpleString()
    bucketed = shown.withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("bucket", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).otherwise(-1))  # no other is with null ids
    kept = bucketed.groupBy("bucket").transformWithStateInPandas(Remembered(keep_ms), out.replace("bigint", ident, 1), "append", mode)
    return chosen(with_default(kept))


def _held(state: GroupState) -> list[pd.DataFrame]:
    if not state.exists:
        return []
    return [pa.ipc.open_stream(state.get[0]).read_pandas()]


def _hold(state: GroupState, rows: pd.DataFrame) -> None:
    if not len(rows):
        return state.remove()
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    state.setTimeoutTimestamp(-int(-rows["until"].min() // 1000))


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Decisions of a bucket's matches, each pair once, and the matches whose wait is over without one; the others are held."""
    new = [df.drop(columns=["bucket", "seen"]) for df in frames if len(df)]  # one without rows when the time is over
    held = _held(state)
    rows = pd.concat([*(df.assign(fresh=False) for df in held), *(df.assign(fresh=True, met=False) for df in new)], ignore_index=True)
    over = rows["until"] <= state.getCurrentWatermarkMs() * 1000
    shown, told = rows[rows["shown"]].reset_index(names="row"), rows[~rows["shown"]]
    pairs = shown.merge(told, on=["doc", "ord"], suffixes=("", "_told"))
    pairs = pairs[(pairs["fresh"] | pairs["fresh_told"]) & pairs["at_told"].between(pairs["at"], pairs["until"])]
    rows.loc[pairs["row"], "met"] = True
    missed = rows[over & rows["shown"] & ~rows["met"]]
    _hold(state, rows[~over].drop(columns="fresh"))
    if len(pairs):
        yield pd.DataFrame({"doc": pairs["doc"], "ord": pairs["ord"], "at": pairs["at"], "told_at": pairs["at_told"].astype("Int64"), "line": pairs["line_told"]})
    if len(missed):
        yield pd.DataFrame({"doc": missed["doc"], "ord": missed["ord"], "at": missed["at"], "told_at": pd.array([None] * len(missed), "Int64"), "line": pd.Series(None, missed.index, dtype=object)})


def _timed(df: DataFrame, at: str, shown: bool, until: Column, line: Column) -> DataFrame:
    ids = [F.col(c).cast("string").alias(n) for c, n in (("doc_id", "doc"), ("match_ord", "ord"))]
    bucket = F.pmod(F.xxhash64("doc", "ord"), F.lit(WAITING)).alias("bucket")
    own = df.where(F.col(at).isNotNull()).select(F.col(at).alias("seen"), *ids, F.lit(shown).alias("shown"), micros(df, at).alias("at"), until.alias("until"), line.alias("line"))
    return own.select(bucket, "*")


def decided_stream(matches: DataFrame, decisions: DataFrame, wait: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """doc_id, match_ord, shown_at, decided_at, line: each match with its decision, or with none once the wait is over.

    matches: doc_id, match_ord, shown_at; decisions: doc_id, match_ord, line, decided_at; both streams of event time.
    A decision counts if it is made at or after the match is shown and within `wait`.  A match without one comes out
    with a null line (no change) when the streams have moved past its wait by `lateness`; what arrives later than
    that is dropped, and so is what has no time.  State goes with the watermark, so it holds what was shown or decided
    within wait and lateness: one value for each of WAITING buckets of matches, in one store for each partition, as a join of
    streams has four of them, which each micro-batch has to write, and several entries for each row.  A bucket's
    rows and what a micro-batch has of it lie in one task's memory.
    """
    m, d = matches.withWatermark("shown_at", lateness), decisions.withWatermark("decided_at", lateness)
    m = m.withColumn("__until", F.col("shown_at") + F.expr(f"INTERVAL {wait}"))
    shown = _timed(m, "shown_at", True, micros(m, "__until"), F.lit(None).cast("string"))
    told = _timed(d.where("doc_id IS NOT NULL AND match_ord IS NOT NULL"), "decided_at", False, micros(d, "decided_at"), F.col("line"))
    made = shown.unionByName(told).groupBy("bucket").applyInPandasWithState(_decide, "doc string, ord string, at bigint, told_at bigint, line string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    kind = lambda df, c: df.schema[c].dataType
    time = lambda c, df, of: F.timestamp_micros(c).cast(kind(df, of)).alias(of)
    return made.select(F.col("doc").cast(kind(matches, "doc_id")).alias("doc_id"), F.col("ord").cast(kind(matches, "match_ord")).alias("match_ord"), time("at", matches, "shown_at"), time("told_at", decisions, "decided_at"), "line")
