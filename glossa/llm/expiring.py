"""Expiring click deduplication: two chained stateful operators over a stream of batches.

The first operator keeps the open window of each click, its opener and its deadline; it tags the
rows of a batch with the window they belong to, opens and closes windows, and sums the tagged
rows up by window before they go on.  The second keeps a window's counters until the event that
closes it arrives.  Windows close when a row beyond the deadline comes, or by a control
event: every batch carries one for each bucket, with the hour before which deadlines have passed, and the
first operator hands it on as the closing of the windows it ends.

State is kept by bucket of clicks, as many buckets as there are BUCKET_ROWS rows, so that Spark calls
each operator for thousands of clicks at once and what is done for them is done in numpy; a bucket
holds open windows only.  The state store is the session's.  Rows alike in click, hour and hash are counted together in the tasks that read
them, before they are shuffled, and again in the bucket, at most CHUNK rows at a time.

Each batch is a start of its own of one query on one checkpoint: an executor or the driver may be lost
within it, and what the start had not committed is done again by the next.

Defined results: rows without an arrival have no hour and take no part; a null click_id is a
click of its own, of one copy, and stands in hashes as empty; other nulls are empty in the hash, as
is a value that is no number; rows alike in everything are repeats; batches without rows pass; a props text of any
length is hashed whole; an empty table gives an empty result and starts no stream; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import micros
from .common import move_folder, stage_folder, table

#: Hours that a window takes repeats for, hours that a row may lag behind, and batches.
OPEN, LATE, BATCHES = 24, 96, 8
BUCKET_ROWS, CHUNK = 50_000, 200_000
#: The hour before which all deadlines have passed.
EVER = 1 << 62

_CHECK = "spark.sql.streaming.unsupportedOperationCheck"

ROWS = "click_id long, hour long, hash binary, crc long, bucket int, before long"
TAGGED = "bucket int, none boolean, click_id long, start_hour long, hash binary, n_repeats long, n_conflicts long, conflict_crc long, closed_batch long"
_ROW = np.dtype([("none", "?"), ("id", "i8"), ("hour", "i8"), ("hash", "S32"), ("crc", "i8"), ("n", "i8")])
_OPEN = np.dtype([("none", "?"), ("id", "i8"), ("start", "i8"), ("deadline", "i8"), ("hash", "S32")])
_COUNT = np.dtype([("none", "?"), ("id", "i8"), ("start", "i8"), ("hash", "S32"), ("repeats", "i8"), ("conflicts", "i8"), ("crc", "i8"), ("closed", "i8")])

def copies(clicks: DataFrame) -> DataFrame:
    """click_id, hour, hash, crc (of the hash) and line (the place along the batches) of every copy."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value = F.floor(100 * F.when(~F.isnan("value"), F.col("value")) + 0.5).cast("long")
    fields = [text(F.col("client_id")), text(F.col("kind")), text(value), text(micros(clicks, "ts")), text(F.col("props"))]
    rows = clicks.select("click_id", F.concat_ws("|", *fields).alias("fields"), F.floor(micros(clicks, "arrived_at") / 3_600_000_000).alias("arrived"))
    rows = rows.where("arrived IS NOT NULL").select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.pmod("click_id", F.lit(3)), F.lit(0)).cast("int"))).alias("j"))
    rows = rows.withColumn("c", F.crc32(F.concat(text(F.col("click_id")), F.lit(":"), text(F.col("j")))))
    hour = F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10)
    rows = rows.select("click_id", "c", "fields", hour.alias("hour"))
    made = F.sha2(F.concat("fields", F.lit("|"), text(F.col("c") % 3)), 256)
    line = F.col("hour") + F.floor(F.col("c") / 10) % 200
    return rows.select("click_id", "hour", line.alias("line"), made.alias("h")).select("click_id", "hour", F.unhex("h").alias("hash"), F.crc32("h").alias("crc"), "line")


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Rows in order of click, hour and hash, equal ones counted together."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["hash"], rows["hour"], rows["id"], rows["none"]))]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for name in ("none", "id", "hour", "hash"):
        new[1:] |= rows[name][1:] != rows[name][:-1]
    at = np.flatnonzero(new)
    out = rows[at]
    if len(at):
        out["n"] = np.add.reduceat(rows["n"], at)
    return out


def _of(pdf: pd.DataFrame) -> np.ndarray:
    rows = np.zeros(len(pdf), _ROW)
    rows["none"] = pdf["none"]
    for to, name in (("id", "click_id"), ("hour", "hour"), ("crc", "crc"), ("n", "n")):
        rows[to] = pdf[name]
    rows["hash"] = pdf["hash"].tolist()
    return rows


def tag(opened: np.ndarray, rows: np.ndarray, batch: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """What a batch does to the open windows: counters by window, and the windows open afterwards.

    rows: joined rows of the batch.  Each round takes one window of every click on: up to the
    first row beyond its deadline, which opens the next.
    """
    both = np.zeros(len(opened) + len(rows), _ROW)
    both["none"], both["id"], both["hash"] = (np.concatenate([opened[c], rows[c]]) for c in ("none", "id", "hash"))
    both["hour"][: len(opened)], both["hour"][len(opened) :] = opened["start"], rows["hour"]
    both["n"][len(opened) :], both["crc"][len(opened) :] = rows["n"], rows["crc"]
    fresh = np.arange(len(both)) >= len(opened)
    order = np.lexsort((both["hash"], both["hour"], fresh, both["id"], both["none"]))  # a window before its rows
    both, fresh = both[order], fresh[order]
    n = len(both)
    if not n:
        return np.zeros(0, _COUNT), opened
    lead = np.ones(n, bool)
    lead[1:] = (both["id"][1:] != both["id"][:-1]) | (both["none"][1:] != both["none"][:-1])
    key, first = np.cumsum(lead) - 1, np.flatnonzero(lead)
    end = np.append(first[1:], n)
    low = int(rows["hour"].min()) - 1 if len(rows) else 0
    place = np.where(fresh, both["hour"] - low, 0)
    span = int(place.max()) + 2
    line = key * span + place
    opens, closed = np.zeros(n, bool), np.full(n, -1)
    at, k = first, np.arange(len(first))
    while len(at):
        opens[at] = True
        upto = np.clip(both["hour"][at] + OPEN - low, 0, span - 1)
        then = np.clip(np.searchsorted(line, k * span + upto, "right"), at + 1, end[k])
        more = then < end[k]
        closed[at[more]] = batch
        at, k = then[more], k[more]
    wins = np.flatnonzero(opens)
    deadline = both["hour"][wins] + OPEN
    ended = np.where((closed[wins] < 0) & (deadline < before), batch, closed[wins])
    own = np.cumsum(opens) - 1
    unlike = both["hash"] != both["hash"][wins][own]
    out = np.zeros(len(wins), _COUNT)
    out["none"], out["id"], out["start"], out["closed"] = both["none"][wins], both["id"][wins], both["hour"][wins], ended
    out["hash"] = np.where(fresh[wins], both["hash"][wins], b"")
    out["repeats"] = np.add.reduceat(both["n"], wins) - fresh[wins]
    out["conflicts"] = np.add.reduceat(np.where(unlike, both["n"], 0), wins)
    out["crc"] = np.add.reduceat(np.where(unlike, both["n"] * both["crc"], 0), wins)
    still = np.zeros(int((ended < 0).sum()), _OPEN)
    stay = ended < 0
    for name in ("none", "id", "start"):
        still[name] = out[name][stay]
    still["deadline"], still["hash"] = deadline[stay], both["hash"][wins][stay]
    return out[fresh[wins] | (out["repeats"] > 0) | (ended >= 0)], still


def _frame(bucket: int, w: np.ndarray) -> pd.DataFrame:
    hashes = np.ascontiguousarray(w["hash"]).view("V32").tolist()
    columns = {"bucket": np.full(len(w), bucket, np.int32), "none": w["none"], "click_id": w["id"], "start_hour": w["start"], "hash": hashes}
    return pd.DataFrame(columns | {"n_repeats": w["repeats"], "n_conflicts": w["conflicts"], "conflict_crc": w["crc"], "closed_batch": w["closed"]})


def _held(state: GroupState, kind: np.dtype) -> np.ndarray:
    """State of a bucket: one array of fixed records."""
    return np.frombuffer(bytes(state.get[0]), kind) if state.exists else np.zeros(0, kind)


def _hold(state: GroupState, records: np.ndarray) -> None:
    if len(records):
        state.update((records.tobytes(),))
    elif state.exists:
        state.remove()


def opener(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First operator: keeps openers and deadlines; gives rows their window."""
    parts, pending, batch, before = [np.zeros(0, _ROW)], 0, 0, -EVER
    for pdf in frames:
        batch = max(batch, int(pdf["batch"].max()))
        control = pdf["before"].notna()
        before = max(before, *pdf["before"][control].astype("int64").tolist(), -EVER)
        parts.append(_of(pdf[~control]))
        pending += len(parts[-1])
        if pending > CHUNK:
            parts, pending = [_joined(parts)], 0
    out, still = tag(_held(state, _OPEN), _joined(parts), batch, before)
    _hold(state, still)
    yield _frame(key[0], out)


def counter(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Second operator: keeps the counters of open windows; gives those that a closing event ends."""
    parts = [_held(state, _COUNT)]
    for pdf in frames:
        part = np.zeros(len(pdf), _COUNT)
        for to, name in (("none", "none"), ("id", "click_id"), ("start", "start_hour"), ("repeats", "n_repeats"), ("conflicts", "n_conflicts"), ("crc", "conflict_crc"), ("closed", "closed_batch")):
            part[to] = pdf[name]
        part["hash"] = pdf["hash"].tolist()
        parts.append(part)
    w = np.concatenate(parts)
    w = w[np.lexsort((w["start"], w["id"], w["none"]))]
    new = np.zeros(len(w), bool)
    new[:1] = True
    for name in ("none", "id", "start"):
        new[1:] |= w[name][1:] != w[name][:-1]
    at = np.flatnonzero(new)
    if len(at):
        sums = w[at]
        for name in ("repeats", "conflicts", "crc"):
            sums[name] = np.add.reduceat(w[name], at)
        sums["closed"] = np.maximum.reduceat(w["closed"], at)
        told = np.flatnonzero(w["hash"] != b"")  # an opener's hash comes once
        sums["hash"][np.searchsorted(at, told, "right") - 1] = w["hash"][told]
        w = sums
    ended = w["closed"] >= 0
    _hold(state, w[~ended])
    yield _frame(key[0], w[ended])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch alike in click, hour and hash as one with their number."""
    for b in batches:
        t = pa.Table.from_batches([b])
        keys = [c for c in b.schema.names if c != "n"]
        yield from t.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).combine_chunks().to_batches()


def window_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """TAGGED rows of closed windows, from a stream of ROWS with their batch."""
    bucket = F.coalesce("bucket", F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int"))
    keyed = rows.select(
        bucket.alias("bucket"), "batch", F.col("click_id").isNull().alias("none"), F.coalesce("click_id", F.lit(0)).alias("click_id"), F.coalesce("hour", F.lit(0)).alias("hour"),
        F.coalesce("hash", F.lit(b"")).alias("hash"), F.coalesce("crc", F.lit(0)).alias("crc"), "before", F.lit(1).cast("long").alias("n"),
    )
    keyed = keyed.mapInArrow(_together, keyed.schema)
    tagged = keyed.groupBy("bucket").applyInPandasWithState(opener, TAGGED, "records binary", "append", GroupStateTimeout.NoTimeout)
    tagged = tagged.withColumn("bucket", F.pmod(F.xxhash64("none", "click_id"), F.lit(buckets)).cast("int"))
    return tagged.groupBy("bucket").applyInPandasWithState(counter, TAGGED, "records binary", "append", GroupStateTimeout.NoTimeout)


def _started(spark: SparkSession, sink: DataStreamWriter) -> StreamingQuery:
    """Start a query with two operators on pandas groups with state.

    Spark's check lets two such operators follow each other in its JVM API but not in its pandas one.  What it
    guards, the order of watermarks and timeouts, does not come up here: neither operator has any.
    """
    before = spark.conf.get(_CHECK, "true")
    spark.conf.set(_CHECK, "false")
    try:
        return sink.start()
    finally:
        spark.conf.set(_CHECK, before)


def expiring_windows(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc and hash of every window.

    The copies are cut into batches along their line, each fed to the query in a start of its own.
    """
    spark = clicks.sparkSession
    folder = stage_folder(spark, "clicks")
    rows = copies(clicks)
    low, high, n = rows.agg(F.min("line"), F.max("line"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string")
    batch = F.floor((F.col("line") - low) * batches / (high - low + 1)).cast("int")
    rows = rows.select("click_id", "hour", "hash", "crc", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("before"), batch.alias("batch"))
    rows.write.partitionBy("batch").parquet(f"{folder}/cut")
    tops = dict(spark.read.parquet(f"{folder}/cut").groupBy("batch").agg(F.max("hour")).collect())  # a row for each batch
    buckets = max(1, -(-n // BUCKET_ROWS))
    latest = None
    for b in range(batches):
        if b in tops:
            move_folder(spark, f"{folder}/cut/batch={b}", f"{folder}/in/batch={b}")
        before = latest - LATE if latest is not None else -EVER
        latest = max(x for x in (latest, tops.get(b)) if x is not None)
        none = (F.lit(None).cast(t).alias(c) for c, t in (("click_id", "long"), ("hour", "long"), ("hash", "binary"), ("crc", "long")))
        control = spark.range(buckets).select(*none, F.col("id").cast("int").alias("bucket"), F.lit(latest - LATE if b < batches - 1 else EVER).alias("before"))
        control.coalesce(1).write.mode("append").parquet(f"{folder}/in/batch={b}")
        stream = spark.readStream.schema(f"{ROWS}, batch int").parquet(f"{folder}/in")
        on_time = stream.where((F.col("hour") >= before) | F.col("before").isNotNull())
        sink = window_counts(on_time, buckets).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        _started(spark, sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.when(~F.col("none"), F.col("click_id")).alias("click_id"), "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


def op13_expiring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiring_windows(table(spark, sf_dir, "clicks"))
