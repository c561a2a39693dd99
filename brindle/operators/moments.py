"""Mergeable moments: deviations of a growing table without reading it again.

A moment row holds the count, mean and sum of squared deviations of one group
of values. Rows of disjoint parts merge into that of their union (Chan, Golub and
LeVeque), so each day is summed up once, stored, and merged with the days stored
before; the crowd metric of all days is then computed from a few numbers a
person and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The partition column of a store.
DAY = "day"


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(``keys``, n, mean, m2) of the values that are not null; one row a group.

    Spark merges partial aggregates before the shuffle, so a hot group is no
    large one. A group without a value has n 0 and nulls.
    """
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def _merged(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def merge(parts: DataFrame, keys: Sequence[str], order: Sequence[str] = (DAY,)) -> DataFrame:
    """One moment row a group of ``keys`` from those of its disjoint parts.

    Parts are merged in ``order``, so a rerun gives the same to the last digit. A
    group has as many parts as it has stored days; see :func:`compact`.
    """
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    own = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(F.col("n").cast("long").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2")).alias("m"))))
    out = parts.groupBy(*keys).agg(F.aggregate(own, zero, lambda a, x: _merged(a, x["m"])).alias("__m"))
    return out.select(*keys, "__m.n", F.when(F.col("__m.n") > 0, F.col("__m.mean")).alias("mean"), F.when(F.col("__m.n") > 0, F.col("__m.m2")).alias("m2"))


def deviation(name: str = "sd") -> Column:
    """Sample deviation of a moment row; null for fewer than two values."""
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias(name)


def add_days(df: DataFrame, path: str, keys: Sequence[str], value: str) -> None:
    """Store the moments of each day in ``df`` by ``keys``, replacing these days alone.

    ``df`` has a column ``day`` and holds each of its days whole; a day that is
    added again, as after a failed job, is not counted twice. Other days are neither
    read nor written.
    """
    rows = moments(df, [*keys, DAY], value)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored moment rows; a filter on ``day`` reads only its folders."""
    return spark.read.option("basePath", path).parquet(path)


def compact(spark: SparkSession, path: str, into: str, keys: Sequence[str], coarse: Column) -> None:
    """Write the store to ``into`` with ``coarse`` (of ``day``, such as its month) as day:
    fewer parts a group. A compacted store takes new days of later ``coarse`` only."""
    rows = stored(spark, path)
    out = merge(rows.withColumn("__coarse", coarse), [*keys, "__coarse"]).withColumnRenamed("__coarse", DAY)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(into)


def metric(rows: DataFrame, person: str, keys: Sequence[str]) -> DataFrame:
    """(``keys``, metric): mean over persons of their deviation, from stored rows."""
    return merge(rows, [*keys, person]).select(*keys, deviation()).groupBy(*keys).agg(F.avg("sd").alias("metric"))
