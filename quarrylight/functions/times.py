"""Time differences that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with microseconds, for timestamps with or without a zone."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def epoch_seconds(ts: Column, dtype: str = "timestamp_ntz") -> Column:
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01'" if dtype == "timestamp_ntz" else "TIMESTAMP'1970-01-01 00:00:00Z'")
    return (ts - zero).cast("interval second").cast("decimal(20,6)")


def epoch_micros(ts: Column, dtype: str = "timestamp_ntz") -> Column:
    return (epoch_seconds(ts, dtype) * 1_000_000).cast("bigint")
