"""From raw documents to shards, in five stages; each is written as Parquet and read again by the next.

Every stage but the last returns the columns of documents.

Defined results: null and empty texts pass the first three stages (they score like an empty text, are linked with
nothing and have no words), and the mix takes them 0 times; null and repeated ids are ordinary rows; texts of any
length go whole through each stage; of rows alike in id and text near-duplicate removal keeps one; with labels of one
kind every document scores their share, and without labels none is dropped; an empty benchmark removes
nothing; empty documents give an empty result; other columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.common import remove_folder, stage_folder, table
from glossa.llm.decontaminate import drop_contaminated
from glossa.llm.mixing import mix_documents
from glossa.llm.near_dedup import deduplicate
from glossa.llm.sharding import shard_documents
from glossa.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes when the next one has written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = stage_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier, sketches and draws are beyond SQL; tests hold the stages that follow rules against plain Python on a small fixture.
ORACLE_SQL: str | None = None
