"""Exact times as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column, whatever the session's zone where the column has none."""
    ts = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(ts.cast("timestamp"))
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
