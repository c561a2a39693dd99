"""Crowd movement: how much the boxes around tracked persons vary, by time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import timebucket

WIDTH_MS = 5000
SKIP_MS = 1000

_BOX = T.StructType().add("Height", T.DoubleType()).add("Width", T.DoubleType())
_PERSON = T.StructType().add("Index", T.LongType()).add("BoundingBox", _BOX)
RECORD = T.StructType().add("Timestamp", T.LongType()).add("Person", _PERSON)


def flatten(records: DataFrame, skip_ms: int | None = SKIP_MS, person_limit: int | None = None) -> DataFrame:
    """(timestamp, person_id, box_height, box_width) of nested tracking records.

    Records without a box, or before ``skip_ms``, are left out. ``person_limit``
    keeps persons whose index is below it; off by default. Both filters and the
    nested columns reach a Parquet scan.
    """
    kept = records.where(F.col("Person.BoundingBox").isNotNull())
    if skip_ms is not None:
        kept = kept.where(F.col("Timestamp") >= skip_ms)
    if person_limit is not None:
        kept = kept.where(F.col("Person.Index") < person_limit)
    return kept.select(
        F.col("Timestamp").alias("timestamp"),
        F.col("Person.Index").alias("person_id"),
        F.col("Person.BoundingBox.Height").alias("box_height"),
        F.col("Person.BoundingBox.Width").alias("box_width"),
    )


def with_bucket(df: DataFrame, ms: Column, width_ms: float = WIDTH_MS, name: str = "interval") -> DataFrame:
    return df.withColumn(name, timebucket.bucket(ms, width_ms))


def person_deviation(df: DataFrame, person: str, values: Sequence[str], keys: Sequence[str] = ("interval",)) -> DataFrame:
    """Sample deviation of each value by ``keys`` and person, as ``<value>_sd``.

    A person with one sample has null. Partial sums meet before the shuffle, so
    a bucket with many samples is no large group.
    """
    return df.groupBy(*keys, person).agg(F.count("*").alias("n_samples"), *(F.stddev_samp(v).alias(f"{v}_sd") for v in values))


def movement_metric(df: DataFrame, person: str, values: Sequence[str], keys: Sequence[str] = ("interval",)) -> DataFrame:
    """Mean over persons of :func:`person_deviation`, by ``keys``, as ``<value>_mean_sd``.

    Persons without a deviation do not count; a key with none stays, with null.
    """
    deviations = person_deviation(df, person, values, keys)
    return deviations.groupBy(*keys).agg(*(F.avg(f"{v}_sd").alias(f"{v}_mean_sd") for v in values))


def normalise(df: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` scaled to 0..1 over the whole frame; null if it is constant.

    The two bounds are one aggregated row, read as a scalar subquery: a window
    over all rows would bring them into one task.
    """
    bounds = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("bounds")).scalar()
    span = F.nullif(bounds["high"] - bounds["low"], F.lit(0.0))
    return df.withColumn(name, (F.col(value) - bounds["low"]) / span)


def metric_rows(df: DataFrame, base: Column, index: str = "interval", width_ms: int = WIDTH_MS) -> DataFrame:
    """``df`` with ``ts``, the time of each bucket counted from ``base``."""
    return df.withColumn("ts", timebucket.bucket_start(base, F.col(index), width_ms))
