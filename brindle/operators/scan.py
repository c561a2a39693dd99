"""Ordered series of any length: prefix scans over ranges of rows.

A window by a key brings all rows of the key into one task. Here the rows are cut
into ranges by key and order; each range is scanned on its own, the ranges' sums
(one small row each) are scanned by key, and what came before a range is added to
its rows. A key that holds most of the rows is spread over as many tasks as it has
ranges. The ranges are written once to the shared folder, so that they stay the
same in both passes and when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut

#: Names that no column of a series may have.
KEY, RANGE, PLACE, TAG = "__key", "__range", "__place", "__tag"


@dataclass(frozen=True)
class Series:
    """Rows in ranges: ``rows`` holds the columns of the frame, ``KEY`` (the key as one
    value, so that nulls are equal and windows and joins share one exchange), ``RANGE``
    and ``TAG``."""

    rows: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    columns: tuple[str, ...]

    @property
    def keys(self) -> tuple[str, ...]:
        return (KEY, RANGE)

    def window(self):
        """The rows of one key in one range, in order."""
        return Window.partitionBy(*self.keys).orderBy(*self.order, TAG)

    def placed(self) -> DataFrame:
        """``rows`` with ``PLACE``, the row's number within key and range, from 0."""
        return self.rows.withColumn(PLACE, F.row_number().over(self.window()).cast("long") - 1)

    def earlier(self, sums: DataFrame, names: Sequence[str]) -> DataFrame:
        """One row a key and range: the sums of the key's earlier ranges (0 for none).

        ``sums`` has a row a key and range, so its windows are as small as the
        number of ranges.
        """
        before = Window.partitionBy(KEY).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumns({n: F.coalesce(F.sum(n).over(before), F.lit(0).cast(sums.schema[n].dataType)) for n in names})

    def join(self, rows: DataFrame, about: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with what ``about`` says of their key and range; nulls are keys too."""
        return rows.join(about, list(self.keys), how)


def series(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> Series:
    """Cut ``df`` into ``ranges`` (the shuffle partitions, unless given) by key and order.

    Rows of equal key and order keep one order from then on, but which is open.
    Nulls come first. A null key is a key of its own.
    """
    number = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(number, *by, *order) if by or order else df
    rows = cut(dealt.withColumn(RANGE, F.spark_partition_id()).withColumn(TAG, F.monotonically_increasing_id()))
    return Series(rows.withColumn(KEY, F.struct(*by) if by else F.struct(F.lit(0))), tuple(by), tuple(order), tuple(df.columns))


def numbered(s: Series, name: str) -> DataFrame:
    """The rows with ``RANGE`` and ``name``, their number within the key, from 0."""
    counts = s.rows.groupBy(*s.keys).agg(F.count("*").alias("__before"))
    return s.join(s.placed(), s.earlier(counts, ["__before"])).withColumn(name, F.col("__before") + F.col(PLACE)).drop("__before", PLACE)


def running_sum(s: Series, rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` of the series with ``name``: the sum of ``value`` over the key's rows
    so far, this one included. Nulls add nothing; before any value it is 0."""
    sums = rows.groupBy(*s.keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("__before"))
    here = F.coalesce(F.sum(value).over(s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))
    return s.join(rows.withColumn("__here", here), s.earlier(sums, ["__before"])).withColumn(name, F.col("__before") + F.col("__here")).drop("__before", "__here")


def neighbours(s: Series, value: str, before: str, after: str) -> DataFrame:
    """The rows with ``value`` of the key's row before and after them, across the
    borders of ranges; null before the first row and after the last."""
    own, keys = F.struct(F.col(value).alias("v")), F.struct(*s.order, TAG)
    ends = s.rows.groupBy(*s.keys).agg(F.min_by(own, keys).alias("__first"), F.max_by(own, keys).alias("__last"))
    ranges = Window.partitionBy(KEY).orderBy(RANGE)
    borders = ends.select(*s.keys, F.lag("__last").over(ranges).alias("__lag_of"), F.lead("__first").over(ranges).alias("__lead_of"))
    # A struct tells a neighbour without a value from no neighbour.
    beside = {"__lag": F.lag(own).over(s.window()), "__lead": F.lead(own).over(s.window())}
    found = s.join(s.rows.withColumns(beside), borders)
    return found.withColumns({before: F.coalesce("__lag", "__lag_of"), after: F.coalesce("__lead", "__lead_of")}).withColumns({n: F.col(n)["v"] for n in (before, after)}).drop("__lag", "__lead", "__lag_of", "__lead_of")


def previous(s: Series, value: str, name: str, default: Column | None = None) -> DataFrame:
    """The rows with ``name``: ``value`` of the key's row before; ``default`` before the
    first row. A null value stays null."""
    marked = Series(s.rows.withColumn("__own", F.struct(F.col(value).alias("v"))), s.by, s.order, s.columns)
    before = neighbours(marked, "__own", "__b", "__a").drop("__own", "__a")
    return before.withColumn(name, F.when(F.col("__b").isNull(), F.lit(None) if default is None else default).otherwise(F.col("__b")["v"])).drop("__b")
