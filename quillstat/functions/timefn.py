"""Timestamp parsing and time helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_timestamp(df: DataFrame, col: str) -> Column:
    """FN6/FN7: numbers are epoch seconds, strings are parsed (ISO, '+0000' offsets
    allowed) to UTC, anything unparsable becomes null."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, (T.TimestampType,)):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return c.cast("timestamp")
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return F.timestamp_micros(F.round(c.cast("double") * 1_000_000).cast("long"))
    s = F.trim(c.cast("string"))
    return F.when(F.length(s) == 0, F.lit(None).cast("timestamp")).otherwise(
        F.coalesce(F.expr(f"try_cast({_q(col)} AS TIMESTAMP)"),
                   F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def epoch_micros(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def floor_to(ts, width_seconds) -> Column:
    """Start of the fixed-width bin (epoch-aligned) that holds ``ts``."""
    us = epoch_micros(ts)
    w = F.lit(1_000_000) * (width_seconds if isinstance(width_seconds, Column) else F.lit(width_seconds))
    return F.timestamp_micros(F.floor(us / w).cast("long") * w)
