"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import checkpointed, scratch_folder

#: White space of the word contracts, as a regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and read on from there.

    With rows_a_task a small result is read by few tasks, so that later shuffles of it do
    not write a file for each of many.  The files go with the DataFrame where
    spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    out = checkpointed(df)
    return out.coalesce(tasks_for(out, rows_a_task)) if rows_a_task else out


def tasks_for(df: DataFrame, rows_a_task: int) -> int:
    return max(1, -(-df.count() // rows_a_task))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefix_sums(buckets: DataFrame, value: str, order: list, out: str, within: list | None = None) -> DataFrame:
    """Add the sum of `value` over all earlier rows of `buckets`, a table of bounded size."""
    from pyspark.sql import Window

    w = (Window.partitionBy(*within) if within else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that starts with `name` and that `docs` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a stage writes."""
    return scratch_folder(spark, f"stage-{name}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete what a stage wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder, with the folders above its new place made first."""
    at, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(at, new):
        raise OSError(f"could not move {path} to {to}")
