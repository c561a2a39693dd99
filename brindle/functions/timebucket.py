"""Time buckets, parsing and offsets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format of the emotion samples' timestamps.
SAMPLE_FORMAT = "yyyyMMdd-HHmmss"


def bucket(ms: Column, width_ms: float) -> Column:
    """The bucket of a time, centred on a multiple of the width: ties go to the even one."""
    return F.bround(ms / F.lit(float(width_ms)), 0).cast("bigint")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def bucket_start(base: Column, index: Column, width_ms: int) -> Column:
    """``base`` plus ``index`` times the width."""
    return F.timestamp_millis(F.unix_millis(base) + index * F.lit(width_ms))


def parse_sample_time(text: Column) -> Column:
    """A sample's timestamp; null if it cannot be parsed."""
    return F.try_to_timestamp(text, F.lit(SAMPLE_FORMAT))


def minute_of_hour(ts: Column) -> Column:
    return F.minute(ts).cast("bigint")


def to_text(ts: Column) -> Column:
    """Date and time without fractional seconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def cutoff(as_of: Column, hours: int) -> Column:
    return as_of - F.make_interval(hours=F.lit(hours))
