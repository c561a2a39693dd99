"""Connected components by contraction.

Each round every node is merged into its neighbour (or itself) of least rank,
and edges are rewritten between what is left. The rank is the id in even rounds,
which ends a star around its least id at once, and pseudo-random in odd ones, so
that long chains shrink by a constant factor too. Edges, nodes and labels stay
in Spark; the driver only sees how many edges are left. Rounds of few edges cost
as many jobs as those of many, so the last ``FEW_EDGES`` are joined by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import counted_cut, cut

#: Far above what any graph needs; a guard against endless loops.
MAX_ROUNDS = 200
#: Most edges that one task goes through, whatever the graph's size.
FEW_EDGES = 10_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (id, to): the least id that each node is connected with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["id", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a long, b long).

    ``component`` is the smallest id of the component. Repeated, reversed and
    self edges are allowed; rows with a null end are left out. Without edges
    the result is empty.
    """
    left, n = counted_cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").distinct())
    labels = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root"))
    left = left.where("a <> b")
    for turn in range(MAX_ROUNDS):
        if n <= FEW_EDGES:
            break
        rank = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn % 2 else c).alias("rank"), c.alias("to"))  # noqa: E731, B023
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min(rank(F.col("b"))).alias("near")).select("id", F.least(rank(F.col("id")), F.col("near"))["to"].alias("to"))
        labels = labels.join(parent.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        if turn % 4 == 3:
            labels = cut(labels)
        ends = left.join(parent.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a").join(parent.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b")
        left, n = counted_cut(ends.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    else:
        raise RuntimeError("components did not converge")
    if n:
        few = F.broadcast(cut(left.coalesce(1).mapInArrow(_roots, "id long, to long")).withColumnRenamed("id", "root"))
        labels = labels.join(few, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    if not turn:
        # Without rounds the root is the least id.
        return cut(labels.withColumnRenamed("root", "component"))
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return cut(labels.join(least, "root").select("id", "component"))
