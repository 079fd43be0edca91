"""Times as whole nanoseconds since 1970 (Spark's own timestamps hold microseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_to_ns(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp")) * F.lit(1000).cast("long")


def seconds_to_ns(column: str | Column) -> Column:
    """Rounded, half away from zero; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double") * F.lit(1e9)).cast("long")


def ns_to_seconds(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("double") / F.lit(1e9)


def ns_to_timestamp(column: str | Column) -> Column:
    """Cut to microseconds, downwards."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_micros(F.floor(c / F.lit(1000)).cast("long"))


#: Nanoseconds of the units that a span of time may name.
SPANS = {"week": 604_800 * 10**9, "day": 86_400 * 10**9, "hour": 3_600 * 10**9, "minute": 60 * 10**9, "second": 10**9, "millisecond": 10**6, "microsecond": 10**3, "nanosecond": 1}
EARLIEST, LATEST = -(2**63) + 1, 2**63 - 1


def span_to_ns(column: str | Column) -> Column:
    """Texts like "10 seconds", whole numbers and a unit, as nanoseconds; others, and units of no fixed length, are null."""
    c = F.col(column) if isinstance(column, str) else column
    pattern = r"^\s*([+-]?\d+)\s+([a-z]+?)s?\s*$"
    table = F.create_map(*(F.lit(x) for k, v in SPANS.items() for x in (k, v)))
    return F.try_multiply(F.regexp_extract(c, pattern, 1).try_cast("long"), F.try_element_at(table, F.regexp_extract(c, pattern, 2)))


def is_time(frame, column: str) -> bool:
    """Whether a column holds points in time."""
    return frame.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")


def is_span(frame, column: str) -> bool:
    """Whether a column holds spans of time."""
    return frame.schema[column].dataType.typeName().startswith("interval") or frame.schema[column].dataType.typeName() == "daytimeinterval"


def min_max_times(times: tuple[int | None, int | None] | None = None) -> tuple[int, int]:
    """Nanoseconds of a range; open ends reach as far as times do."""
    low, high = times or (None, None)
    low, high = EARLIEST if low is None else low, LATEST if high is None else high
    if low > high:
        raise ValueError("the range ends before it begins")
    return low, high
