"""Fuzzy sets that stay data: degrees by an interval join, for set tables of any size.

A set of straight pieces is a few rows, one a piece: the interval (low, high] it
covers and the line of its degree there. A number meets the pieces that cover it by
an equality of cells: every piece lies in at most two cells of a grid whose width
is the power of two next above its length, and a number looks into one cell of each
grid that any piece uses. So neither the sets nor pairs of numbers and sets that do
not meet are ever listed, and no set reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import scan

#: Pieces of each shape by breakpoints: (from, to, where the degree is 0, where it is 1),
#: as places in ``points``; None: without end, or a degree of 1 throughout.
PIECES = {
    "Z": ((None, 0, None, None), (0, 1, 1, 0)),
    "S": ((0, 1, 0, 1), (1, None, None, None)),
    "Lambda": ((0, 1, 0, 1), (1, 2, 2, 1)),
    "Pi": ((0, 1, 0, 1), (1, 2, None, None), (2, 3, 3, 2)),
}


def pieces(table: DataFrame) -> DataFrame:
    """(domain, position, set_name, low, high, zero, one): the pieces of a set table
    of shapes Z, S, Lambda and Pi. An open end is null; a piece whose degree is 1
    throughout has no ``zero``.

    A boundary belongs to the earlier piece, also where breakpoints descend; a
    piece of no width is left out. A shape of another name is an error.
    """
    point = lambda k: F.lit(None).cast("double") if k is None else F.get("points", F.lit(k))

    def listed(kind: str) -> Column:
        rows = []
        for first, last, zero, one in PIECES[kind]:
            # Whatever an earlier piece covers is its own.
            low = F.lit(None).cast("double") if first is None else F.array_max(F.slice("points", 1, first + 1))
            rows.append(F.struct(low.alias("low"), point(last).alias("high"), point(zero).alias("zero"), point(one).alias("one")))
        return F.array(*rows)

    every = reduce(lambda chain, kind: chain.when(F.col("shape") == kind, listed(kind)), list(PIECES)[1:], F.when(F.col("shape") == next(iter(PIECES)), listed(next(iter(PIECES)))))
    known = every.otherwise(F.raise_error(F.concat(F.lit("no pieces of shape "), F.coalesce("shape", F.lit("null")))))
    out = table.select("domain", "position", "set_name", F.explode(known).alias("p")).select("domain", "position", "set_name", "p.*")
    return out.where(F.col("low").isNull() | F.col("high").isNull() | (F.col("high") > F.col("low")))


def degree(x: Column) -> Column:
    """The degree of ``x`` on a piece that covers it."""
    return F.when(F.col("zero").isNull(), 1.0).otherwise((x - F.col("zero")) / (F.col("one") - F.col("zero")))


def _level(length: Column) -> Column:
    """The power of two whose grid cells are wider than ``length``."""
    return (F.floor(F.log2(length)) + 1).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def fuzzify_table(df: DataFrame, columns: dict[str, str], table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(``keep``, domain, position, set_name, degree) of all degrees above 0.

    ``columns`` names the input of each domain; sets of other domains are not read.
    A null has no degree; NaN and infinity have degree 1 in sets without an upper
    end, minus infinity in those without a lower one; equal rows of ``df`` come as
    often as they are. Without sets, or without rows, there is no row. Breakpoints
    are finite.
    """
    rows = df.select(*keep, F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(c).cast("double").alias("x")) for d, c in columns.items()))).alias("__i"))
    rows = rows.select(*keep, "__i.*").where(F.col("x").isNotNull())
    own = pieces(table.where(F.col("domain").isin(list(columns))))
    # What has no end is as long as the numbers reach: one row a domain.
    infinite = F.lit(float("inf"))
    real = rows.where(F.abs("x") < infinite)
    reach = real.groupBy(F.col("domain").alias("__d")).agg(F.min("x").alias("__min"), F.max("x").alias("__max"))
    ends = own.join(F.broadcast(reach), F.col("domain") == F.col("__d")).withColumns({"__from": F.coalesce("low", F.least("__min", "high")), "__to": F.coalesce("high", F.greatest("__max", "low"))})
    ends = ends.where((F.col("__to") >= F.col("__min")) & (F.col("__from") <= F.col("__max")))
    ends = ends.withColumns({"__from": F.greatest("__from", "__min"), "__to": F.least("__to", "__max")})
    # A stretch of no length, as where all numbers are equal, lies in the finest grid in use.
    placed = ends.withColumn("__level", F.when(F.col("__to") > F.col("__from"), _level(F.col("__to") - F.col("__from"))).otherwise(F.lit(0)))
    cells = F.array_distinct(F.array(_cell(F.col("__from"), F.col("__level")), _cell(F.col("__to"), F.col("__level"))))
    placed = placed.select(F.col("domain").alias("__of"), "position", "set_name", "low", "high", "zero", "one", "__level", F.explode(cells).alias("__cell"))
    # Levels are exponents of doubles, so there are some two thousand at most.
    levels: dict[str, list[int]] = {}
    for r in placed.select("__of", "__level").distinct().collect():
        levels.setdefault(r["__of"], []).append(r["__level"])
    if not levels:
        looked = real.withColumns({"__l": F.lit(0), "__c": F.lit(0).cast("long")}).limit(0)
    else:
        own_levels = F.create_map(*(c for d, found in levels.items() for c in (F.lit(d), F.array(*map(F.lit, sorted(found))))))
        looked = real.withColumn("__l", F.explode(F.try_element_at(own_levels, F.col("domain")))).withColumn("__c", _cell(F.col("x"), F.col("__l")))
    met = looked.join(placed, (F.col("domain") == F.col("__of")) & (F.col("__l") == F.col("__level")) & (F.col("__c") == F.col("__cell")))
    covered = (F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") <= F.col("high")))
    names = [*keep, "domain", "position", "set_name"]
    found = met.where(covered).select(*names, degree(F.col("x")).alias("degree")).where(F.col("degree") > 0)
    endless = own.where(F.col("low").isNull() | F.col("high").isNull()).select(F.col("domain").alias("__of"), "position", "set_name", F.col("high").isNull().alias("__up"))
    beyond = rows.where(~(F.abs("x") < infinite)).join(endless, (F.col("domain") == F.col("__of")) & (F.col("__up") == (F.col("x") > 0)))
    return found.unionByName(beyond.select(*names, F.lit(1.0).alias("degree")))


def partition_sets(df: DataFrame, value: str, domain: str) -> DataFrame:
    """A set table that shares a domain out among the different values of ``df``: each
    is the peak of a triangle between its neighbours, the outermost without end.
    Degrees of a number add up to 1. Nulls and NaN are left out, and so is a single value,
    which has no neighbour. Neighbours are found range by range, so there may be
    any number of values.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).distinct()
    beside = scan.neighbours(scan.series(values, ["v"]), "v", "before", "after")
    inner, first, last = F.col("before").isNotNull() & F.col("after").isNotNull(), F.col("before").isNull(), F.col("after").isNull()
    shape = F.when(inner, "Lambda").when(first & ~last, "Z").when(last & ~first, "S")
    points = F.when(inner, F.array("before", "v", "after")).when(first, F.array("v", "after")).otherwise(F.array("before", "v"))
    rows = scan.numbered(scan.series(beside.where(shape.isNotNull()), ["v"]), "position")
    typical = F.col("v")
    return rows.select(F.lit(domain).alias("domain"), "position", F.format_string("%s-%d", F.lit(domain), "position").alias("set_name"), shape.alias("shape"), points.alias("points"), typical.alias("typical"))
