"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids are in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, n: int) -> DataFrame:
    """text and y (0 or 1) of at most 2 * n rows outside the held-out fold.

    The n labelled ids of documents of the smallest hash are taken (repeated labels: the larger counts);
    an id that several documents share gives the two of the smallest text hash.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held))
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return cut_lineage(found.withColumn("nth", nth).where("nth <= 2").select("text", "y"))
