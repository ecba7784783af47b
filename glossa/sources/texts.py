"""Texts from arguments and files, and results back to files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times a file's bytes that a task takes at most, with some room: ten copies by the reader and the rows it makes, six by a
#: task that gets such a row and writes it as Parquet.
COPIES = 16


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """doc_id (from 0), text."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def from_files(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """path (or columns drawn from it in its place), valid, text: each file one document, strictly UTF-8, line ends folded to newlines.

    Files that are not UTF-8 have valid = false and a null text, so one of many does not end a job.
    A file is one row, so its bytes lie in one task's memory; line ends are folded on these bytes, as
    a pattern would take several copies of the text in wider characters.  Rows are handed to the next step by a
    shuffle: a task that gets one has a single copy of it, while the one that made it has several.  Where not
    every core of an executor can take one of the largest files, its tasks run one at a time.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    folded = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    docs = raw.select(*(columns or ("path",)), ok.alias("valid"), F.when(ok, folded).alias("text"))
    cores, heap = executor(spark)
    if not one_at_a_time(cores, heap, raw.agg(F.max("length")).first()[0] or 0):
        cores = 1
    return _taking(_taking(docs, cores).repartition(*docs.drop("valid", "text").columns), cores)


def _taking(df: DataFrame, cores: int) -> DataFrame:
    """df, with each task of the stage that gives it taking so many cores.

    Of DataFrames only Python's steps take a resource profile, which then holds for their whole stage, so one that gives no row joins it.
    """
    if cores == 1:
        return df
    profile = _profile(df.sparkSession.sparkContext.applicationId, cores)
    return df.unionAll(df.sparkSession.range(0, 1, 1, 1).mapInArrow(lambda _: iter(()), df.schema, profile=profile))


@lru_cache
def _profile(application: str, cores: int) -> ResourceProfile:
    """The same one whenever it is asked for, as Spark takes no two in one stage."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def executor(spark: SparkSession) -> tuple[int, int]:
    """Cores of an executor, one where that is not known, and the bytes of its heap; a local session has no executors and no profiles."""
    sc = spark.sparkContext._jsc.sc()
    conf, number = sc.conf(), sc.getExecutorMemoryStatus().size() - 1  # the driver is among them
    known = number > 0 and not conf.contains("spark.default.parallelism")
    cores = conf.getInt("spark.executor.cores", sc.defaultParallelism() // number if known else 1) if number > 0 else 1
    return max(cores, 1), conf.getSizeAsBytes("spark.executor.memory", "1g")


def one_at_a_time(cores: int, heap: int, largest: int) -> bool:
    """Whether an executor's heap has no room for as many files of the largest size as it has cores."""
    return cores > 1 and cores * COPIES * largest > heap


def replace_texts(spark: SparkSession, path: str, revise: Callable[[DataFrame], DataFrame]) -> None:
    """Put revise(docs) in the place of a folder of Parquet documents: written beside it first, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    write_texts(revise(spark.read.parquet(path)), new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if not (fs.rename(at(path), at(old)) and fs.rename(at(new), at(path))):
        raise OSError(f"could not replace {path}; what it held is in {old}, the revised texts in {new}")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)


def write_texts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results as Parquet, one row for each document."""
    df.write.mode(mode).parquet(path)
