"""Time expressions for TIMESTAMP_NTZ columns.

They use interval arithmetic and casts only: functions such as ``timestamp_diff``,
``timestamp_add`` and ``date_format`` read a zone-less value in the session time
zone, so a daylight-saving change there would shift the result by an hour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def parse_timestamp(text: Column) -> Column:
    """Text to timestamp; anything unreadable becomes null instead of failing the job."""
    return text.try_cast("timestamp_ntz")


def elapsed_micros(start: Column, end: Column) -> Column:
    """Exact elapsed time as BIGINT microseconds."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def elapsed_days(start: Column, end: Column) -> Column:
    """Elapsed time in fractional days, negative when ``end`` comes first."""
    return elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY))


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour periods between two instants (not calendar days)."""
    return F.floor(elapsed_days(start, end)).cast("bigint")


def plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def year_month(ts: Column) -> Column:
    """``YYYY-MM`` of a timestamp."""
    return F.substring(ts.cast("string"), 1, 7)
