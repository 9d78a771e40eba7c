"""Day differences, month buckets and day ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed time in whole days, rounded down (so -1 for one second back)."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.floor(seconds / F.lit(86400)).cast("bigint")


def month_of(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def as_of_timestamp(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def age_days(col: Column, as_of: str) -> Column:
    """Calendar days from ``col`` to the reference date."""
    return F.datediff(F.lit(as_of).cast("date"), col.cast("date")).cast("bigint")
