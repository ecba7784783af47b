"""Registered queries of joins over intervals and times, and of reviews as streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.context import boundaries
from ..functions.patterns import WORD
from ..functions.times import micros
from ..operators.asof import asof_join
from ..operators.frequent import top_items
from ..operators.intervals import interval_join
from ..operators.levels import level_counts
from ..operators.suggest import protected_by_kind, suggest, tokens
from ..scratch import checkpointed, scratch_folder
from ..streaming.review import decided_stream, keyed_state, remembered_stream
from . import oracle
from .queries import answer_line, corpus_lexicon, prose

#: Microseconds of a minute, and of how long a change is in hand.
MINUTE, IN_HAND = 60_000_000, 3_600_000_000
#: Seconds that a decision may take, and since 1970 of the first thing shown (a watermark starts at 0, and what is not after it is late).
WAIT, START = 3600, 1_000_000_000
PARTS = 3


def protected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with every region of code or link that it overlaps, as tables; words that overlap none have no pair and stay out of the join."""
    docs = prose(spark, sf_dir)
    regions = docs.select("doc_id", F.inline(protected_by_kind(F.col("text"))))
    pairs = interval_join(tokens(docs, protected=True), regions, ["doc_id"], width=16)
    return pairs.select("left.doc_id", "left.start", "left.end", "right.kind", F.col("right.start").alias("from"), F.col("right.end").alias("to"))


def sales_in_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales that were under way while a change of their client was in hand; one client has many of both."""
    sales, changes = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "client_changes"))
    sales = sales.select("client_id", "sale_id", micros(sales, "sold_at").alias("start"), micros(sales, "arrived_at").alias("end"))
    since = micros(changes, "valid_at")
    changes = changes.select("client_id", "change_id", since.alias("start"), (since + IN_HAND).alias("end"))
    pairs = interval_join(sales, changes, ["client_id"], width=MINUTE)
    return pairs.select("left.client_id", "left.sale_id", "right.change_id", F.col("left.start").alias("sold"), F.col("right.start").alias("changed"))


def asof_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale with the last change of its client at or before it."""
    sales, changes = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "client_changes"))
    got = asof_join(sales.select("sale_id", "client_id", "sold_at"), changes.select("change_id", "client_id", "seq", "valid_at"), ["client_id"], "sold_at", "valid_at", tie=["seq"])
    return got.select("left.sale_id", "left.client_id", "right.change_id", "right.seq")


def asof_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence with the last sentence boundary at or before it."""
    docs = prose(spark, sf_dir)
    found = suggest(docs, corpus_lexicon()).select("doc_id", "start")
    bounds = docs.select("doc_id", F.explode(boundaries(F.col("text"))).alias("boundary"))
    return asof_join(found, bounds, ["doc_id"], "start", "boundary").select("left.doc_id", "left.start", "right.boundary")


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent words of each language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("lang", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    return top_items(words, ["lang", "source"], "word", 10).withColumn("rank", F.col("rank").cast("long"))


def suggest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents that have them, by language, source, base and suffix, with all totals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    found = suggest(prose(spark, sf_dir), corpus_lexicon()).groupBy("doc_id", "base", "suffix").agg(F.count(F.lit(1)).alias("times"))
    return level_counts(found.join(docs, "doc_id"), ["lang", "source", "base", "suffix"], "doc_id", weight="times").withColumnRenamed("ids", "docs")


def _run(spark: SparkSession, stream_of: Callable[..., DataFrame], parts: list[dict[str, DataFrame]]) -> DataFrame:
    """What a query gives for the parts, each fed in a start of its own on one checkpoint in a new folder."""
    folder = scratch_folder(spark, "stream")
    for part in parts:
        for name, df in part.items():
            df.write.mode("append").parquet(f"{folder}/{name}")
        streams = {name: spark.readStream.schema(df.schema).parquet(f"{folder}/{name}") for name, df in part.items()}
        sink = stream_of(**streams).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remembered defaults of a review whose answers arrive in several starts of a stream."""
    rows = suggest(prose(spark, sf_dir), corpus_lexicon()).select("doc_id", "match_ord", "start", "base", "alternatives", "raws", answer_line().alias("line"))
    rows = checkpointed(rows.withColumn("part", F.least(F.floor(F.sqrt(F.col("match_ord") / 10)), F.lit(PARTS - 1))))
    parts = [{"answered": rows.where(F.col("part") == i).drop("part")} for i in range(PARTS)]
    with keyed_state(spark):
        out = _run(spark, lambda answered: remembered_stream(answered), parts)
    return out.select("doc_id", F.col("match_ord").cast("long").alias("match_ord"), F.col("default_no").cast("long").alias("default_no"))


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence with its decision, or none where it is missing, made before it was shown or after an hour."""
    seconds = lambda c: F.timestamp_seconds(c)
    k = F.col("doc_id") * 31 + F.col("match_ord") * 7
    took = F.when(k % 11 == 0, 2 * WAIT).when(k % 5 == 0, -5).otherwise(k % WAIT)
    rows = suggest(prose(spark, sf_dir), corpus_lexicon()).select("doc_id", "match_ord", (F.col("doc_id") * 60 + F.col("match_ord") + START).alias("shown"), k.alias("k"), took.alias("took"))
    top = (spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id")).first()[0] or 0) + 1
    rows, dealt = rows.withColumn("part", F.floor(F.col("doc_id") * PARTS / top)), scratch_folder(spark, "dealt")
    rows.write.partitionBy("part").parquet(dealt)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("match_ord"), F.lit(None).cast("string").alias("line"), seconds(F.lit(START + 60 * top + 100 * WAIT)).alias("at"))  # moves both streams past every wait
    parts = []
    for i in range(PARTS):
        own = spark.read.schema(rows.schema).parquet(dealt).where(F.col("part") == i)
        told = own.where("k % 7 <> 0").select("doc_id", "match_ord", (F.col("k") % 4).cast("string").alias("line"), seconds(F.col("shown") + F.col("took")).alias("decided_at"))
        own = own.select("doc_id", "match_ord", seconds(F.col("shown")).alias("shown_at"))
        if i == PARTS - 1:
            own, told = own.unionByName(end.select("doc_id", "match_ord", F.col("at").alias("shown_at"))), told.unionByName(end.select("doc_id", "match_ord", "line", F.col("at").alias("decided_at")))
        parts.append({"matches": own, "decisions": told})
    out = _run(spark, lambda matches, decisions: decided_stream(matches, decisions, f"{WAIT} seconds", "3 hours"), parts).where("doc_id >= 0")
    return out.select("doc_id", F.col("match_ord").cast("long").alias("match_ord"), F.unix_seconds("shown_at").alias("shown"), F.unix_seconds("decided_at").alias("decided"), "line")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "protected_pairs": protected_pairs,
    "sales_in_changes": sales_in_changes,
    "asof_changes": asof_changes,
    "asof_sentences": asof_sentences,
    "top_words": top_words,
    "suggest_levels": suggest_levels,
    "stream_defaults": stream_defaults,
    "stream_decisions": stream_decisions,
}

ORACLE_SQL: dict[str, str] = {
    "protected_pairs": f'{oracle.HEAD}, {oracle.PROTECTED} SELECT w.doc_id, w.st AS start, w.en AS "end", kind, r.st AS "from", r.en AS "to" FROM words w JOIN raw r ON r.doc_id = w.doc_id AND r.st < w.en AND r.en > w.st',
    "sales_in_changes": f"""WITH s AS (SELECT client_id, sale_id, epoch_us(sold_at) AS a, epoch_us(arrived_at) AS b FROM sales WHERE sold_at <= arrived_at),
        c AS (SELECT client_id, change_id, epoch_us(valid_at) AS a FROM client_changes)
        SELECT s.client_id, sale_id, change_id, s.a AS sold, c.a AS changed FROM s JOIN c ON s.client_id = c.client_id AND s.a < c.a + {IN_HAND} AND c.a < s.b""",
    "asof_changes": """WITH s AS (SELECT row_number() OVER () AS n, * FROM sales),
        best AS (SELECT n, arg_max({'i': change_id, 's': seq}, {'t': valid_at, 's': seq, 'i': change_id}) AS c FROM s JOIN client_changes c ON c.client_id = s.client_id AND c.valid_at <= s.sold_at GROUP BY n)
        SELECT sale_id, client_id, best.c.i AS change_id, best.c.s AS seq FROM s LEFT JOIN best USING (n)""",
    "asof_sentences": f"{oracle.BASE}, {oracle.BOUNDS} SELECT s.doc_id, s.st AS start, CAST(max(CASE WHEN b <= s.st THEN b END) AS BIGINT) AS boundary FROM sug s LEFT JOIN bounds USING (doc_id) GROUP BY s.doc_id, s.st",
    "top_words": r"""WITH w AS (SELECT lang, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
        c AS (SELECT lang, source, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT lang, source, word, n, row_number() OVER (PARTITION BY lang, source ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 10""",
    "suggest_levels": f"""{oracle.BASE}, o AS (SELECT d.lang, d.source, base, suf AS suffix, doc_id FROM sug JOIN documents d USING (doc_id))
        SELECT lang, source, base, suffix, CAST(grouping(lang, source, base, suffix) AS BIGINT) AS level, count(*) AS n, count(DISTINCT doc_id) AS docs FROM o GROUP BY CUBE (lang, source, base, suffix)""",
    "stream_defaults": oracle.ORACLE_SQL["remembered_defaults"],
    "stream_decisions": f"""{oracle.BASE}, shown AS (SELECT doc_id, ord, doc_id * 60 + ord + {START} AS shown, doc_id * 31 + ord * 7 AS k FROM sug),
        told AS (SELECT doc_id, ord, shown + CASE WHEN k % 11 = 0 THEN {2 * WAIT} WHEN k % 5 = 0 THEN -5 ELSE k % {WAIT} END AS decided, CAST(k % 4 AS VARCHAR) AS line FROM shown WHERE k % 7 <> 0)
        SELECT s.doc_id, s.ord AS match_ord, s.shown, t.decided, t.line FROM shown s LEFT JOIN told t ON t.doc_id = s.doc_id AND t.ord = s.ord AND t.decided BETWEEN s.shown AND s.shown + {WAIT}""",
}
