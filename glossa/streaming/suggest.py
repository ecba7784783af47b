"""The same suggestions over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.suggest import suggest
from ..sources.lexicon import Lexicon


def documents_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of (doc_id, text) in a folder."""
    return spark.readStream.schema("doc_id bigint, text string").parquet(path)


def suggest_stream(docs: DataFrame, out: str, checkpoint: str, lexicon: Lexicon | None = None, context: bool = False, **trigger) -> StreamingQuery:
    """Append suggestions to Parquet files under `out`; stateless, so exactly once by the sink's log."""
    found = suggest(docs, lexicon, context)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
