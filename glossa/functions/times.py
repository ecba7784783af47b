"""Timestamps as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    t = F.col(f"`{name}`")
    if df.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(t)
    seconds = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
