"""Times in seconds since 1970 as dates; real calendar dates in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _time(seconds: Column) -> Column:
    # without a zone, so that the session's doesn't matter
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def simple_date(seconds: Column) -> Column:
    """year, month, day, hour, minute, second."""
    at = _time(seconds)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return F.when(seconds.isNotNull(), F.struct(*[f(at).alias(n) for n, f in parts.items()]))


def format_date(seconds: Column) -> Column:
    """YYYY-MM-DD."""
    return F.date_format(_time(seconds), "yyyy-MM-dd")


def format_date_time(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(_time(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
