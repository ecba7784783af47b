"""The session for single texts: the active one, or a small local one."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.master("local[2]").appName("glossa").config("spark.ui.enabled", "false")
    spark = b.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
