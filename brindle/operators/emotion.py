"""Emotion samples: totals, shares and order-dependent statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import scan

EMOTIONS = ("happy", "sad", "calm")


def scale(df: DataFrame, columns: Sequence[str] = EMOTIONS, by: float = 100.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(by) for c in columns})


def to_long(df: DataFrame, columns: Sequence[str] = EMOTIONS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample and emotion: ``keep``, emotion, value."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in columns], "emotion", "value")


def totals(long: DataFrame) -> DataFrame:
    return long.groupBy("emotion").agg(F.sum("value").alias("total"))


def shares(sums: DataFrame, value: str = "total", digits: int = 1) -> DataFrame:
    """``sums`` with ``share``, percent of the grand total; null if that is 0.
    ``sums`` has one row a category."""
    whole = sums.agg(F.sum(value)).scalar()
    return sums.withColumn("share", F.round(F.try_divide(F.lit(100.0) * F.col(value), whole), digits))


def grand_total(df: DataFrame, columns: Sequence[str] = EMOTIONS) -> Column:
    """An aggregate: the sum over all columns, cut to a whole number."""
    return F.sum(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))).cast("bigint")


def running_average(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "running", ranges: int | None = None) -> DataFrame:
    """The recursive average ``a_i = (v_i + a_0 + ... + a_(i-1)) / (i + 1)``.

    In closed form ``a_i = T_i + v_i / (i + 2)`` for i > 0, with ``T_i`` the
    running sum of ``v_k / ((k + 1) (k + 2))``: two prefix scans over ranges of
    rows, so a series of any length is spread over tasks. A null value adds nothing
    and has no average.
    """
    s = scan.series(df, order, by, ranges)
    i = F.col("__i").cast("double")
    steps = scan.numbered(s, "__i").withColumn("__step", F.col(value) / ((i + 1) * (i + 2)))
    return scan.running_sum(s, steps, "__step", "__so_far").withColumn(name, F.col("__so_far") + F.col(value) / (i + 2)).select(*(c for c in df.columns if c != name), name)


def change_points(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Rows whose value differs from the one before; before the first it is 0.

    The row before is looked up within ranges of rows and across their borders:
    neither a long series nor one without ``by`` passes through one task.
    """
    s = scan.series(df, order, by, ranges)
    return scan.previous(s, value, "__before", F.lit(0)).where(~F.col(value).eqNullSafe(F.col("__before"))).select(*df.columns)


def decayed_sum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Sum of values weighted from 1 down in equal steps: ``v_i (n - i) / n``.

    A range of rows adds up its values, and its values times their places in it; what
    lies before the range is known from the ranges' counts, so no row is moved
    a second time.
    """
    s = scan.series(df, order, by, ranges)
    v = F.col(value).cast("double")
    parts = s.placed().groupBy(*s.keys).agg(F.count("*").alias("__c"), F.sum(v).alias("__v"), F.sum(v * F.col(scan.PLACE)).alias("__vp"))
    before = s.earlier(parts.withColumn("__before", F.col("__c")), ["__before"])
    sums = before.groupBy(scan.KEY).agg(F.sum("__c").alias("__n"), F.sum("__v").alias("__s"), F.sum(F.col("__v") * F.col("__before") + F.col("__vp")).alias("__p"))
    return sums.select(*(F.col(scan.KEY)[c].alias(c) for c in by), (F.col("__s") - F.col("__p") / F.col("__n")).alias("weighted"))


def means(df: DataFrame, columns: Sequence[str] = EMOTIONS) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in columns))


def latest(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each group, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*by, "__row.*")


def recent_samples(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The first ``n`` rows by ``order``: a bounded report."""
    return df.orderBy(*order).limit(n)
