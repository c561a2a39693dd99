"""Centroid clustering by ball k-means.

A cluster is a ball: its centroid, and as radius the largest distance of a
member. Only clusters whose centroid is nearer than twice the radius can take a
member away; they are the ball's neighbours. Members nearer to the centroid than
half the way to the nearest neighbour are the stable core and are not compared
at all; the others lie in annuli, one a neighbour in order of distance, and a
member of the i-th annulus is compared exactly with the first i neighbours alone.

Vectors are kept in blocks with their clusters and the block's sums; a round
reads one written state and writes the next, and the driver gets one sum a
cluster. Numbers are integers, so nothing depends on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import drop_folder, scratch_folder
from brindle.llm.vectors import finite, integers, number_type, pack, shrunk, slices, unpack

CLUSTERS, ROUNDS, SCALE, DIMENSION, SALT = 40, 5, 256, 64, "2"


def nearest(points: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the centroids ``among``, an
    ascending list; ties go to the smaller number."""
    kind = number_type(points.shape[1], points, centroids)
    x, c = points.astype(kind), centroids[among].astype(kind)
    far = (c * c).sum(axis=1) - 2 * (x @ c.T)
    best = np.argmin(far, axis=1)
    return among[best], ((x * x).sum(axis=1) + far[np.arange(len(x)), best]).astype(np.int64)


def squared(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between all centroids."""
    kind = number_type(centroids.shape[1], centroids)
    c = centroids.astype(kind)
    n = (c * c).sum(axis=1)
    return (n[:, None] + n[None] - 2 * (c @ c.T)).astype(np.int64)


def reassign(points: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, given its cluster of the round
    before and ``between`` = :func:`squared` of the centroids; and how many
    distances to other centroids were taken.

    A centroid is skipped only if four times the squared distance to the own one
    is less than that between the two: then it is farther, and no tie.
    """
    own = points.astype(np.int64) - centroids[cluster]
    far, out, compared = (own * own).sum(axis=1), cluster.copy(), 0
    for j in np.unique(cluster):
        members = np.flatnonzero(cluster == j)
        reach = 4 * far[members]
        near = np.flatnonzero(between[j] <= reach.max())
        near = near[near != j]
        near = near[np.argsort(between[j, near], kind="stable")]
        annulus = np.searchsorted(between[j, near], reach, side="right")
        for depth in np.unique(annulus[annulus > 0]):
            rows = members[annulus == depth]
            out[rows], far[rows] = nearest(points[rows], centroids, np.sort(np.append(near[:depth], j)))
            compared += len(rows) * int(depth)
    return out, far, compared


def _totals(points: np.ndarray, cluster: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """(k, 2 + d): members, their squared distances and their sum by cluster."""
    out = np.zeros((k, 2 + points.shape[1]), np.int64)
    np.add.at(out, cluster, np.column_stack([np.ones(len(far), np.int64), far, points.astype(np.int64)]))
    return out


@dataclass
class Clustering:
    """Members in blocks at ``path``; of each cluster its centroid, members and squared distances."""

    spark: object
    path: str
    centroids: np.ndarray
    members: np.ndarray
    inertia: np.ndarray

    def assignments(self, id_col: str = "vec_id") -> DataFrame:
        """(id, cluster, distance) of every vector."""
        blocks = self.spark.read.parquet(self.path).select("ids", "cluster", "distance")
        schema = T.StructType([T.StructField(id_col, blocks.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    cluster, distance = (unpack(batch.column(c)[at].as_py()) for c in ("cluster", "distance"))
                    yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))], schema.fieldNames())

        return blocks.mapInArrow(run, schema)

    def clusters(self) -> DataFrame:
        """(cluster, members, cluster_inertia, centroid, centroid_sha256), one row a cluster."""
        rows = []
        for k, c in enumerate(self.centroids.tolist()):
            rows.append((k, int(self.members[k]), int(self.inertia[k]), c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()))
        return self.spark.createDataFrame(rows, "cluster int, members long, cluster_inertia long, centroid array<long>, centroid_sha256 string")


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, salt: str = SALT) -> Clustering:
    """Cluster the vectors of exactly ``dimension`` finite components.

    Centroids start as the ``k`` vectors of least SHA-256 of ``salt:id`` in hex
    (a null id counts as an empty text; ties by the vector; fewer than ``k``
    vectors start as many). Each round assigns all vectors, then every non-empty
    cluster's centroid becomes the floor of its members' mean. Then all are assigned
    once more. Null vectors and those with null, infinite or NaN components or
    of another length are left out; repeated rows count as often as they come.
    Without a vector there is no cluster and no row. Other columns are not read. A component so large that squared distances leave 64
    bits is an error.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(finite(F.col("v")) & (F.size("v") == dimension))
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = rows.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    centroids = integers(pa.array([r.v for r in start], pa.list_(pa.float64())), scale).reshape(-1, dimension)
    n_clusters, folder = len(centroids), scratch_folder(spark, "balls")
    state = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("points", "cluster", "distance", "totals"))])

    def block(ids: pa.Array, points: np.ndarray, cluster: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        packed = (shrunk(points), shrunk(cluster), shrunk(far), _totals(points, cluster, far, n_clusters))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([pack(x)], pa.binary()) for x in packed)], state.fieldNames())

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            points = integers(batch.column("v"), scale)
            yield block(batch.column("id"), points, *nearest(points, shared.value, np.arange(n_clusters)))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = squared(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                points, cluster = (unpack(batch.column(c)[at].as_py()) for c in ("points", "cluster"))
                found, far, _ = reassign(points, cluster.astype(np.int64), shared.value, between)
                yield block(batch.column("ids")[at].values, points, found, far)

    names = ["n", "inertia", *(f"s{i}" for i in range(dimension))]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in names)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_clusters, len(names)), np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += unpack(x.as_py())
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(c) for c in total[used].T)], schema.fieldNames())

    members, inertia = np.zeros(n_clusters, np.int64), np.zeros(n_clusters, np.int64)
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(centroids)
        path = f"{folder}/round-{turn}"
        if turn == 0:
            rows.mapInArrow(begin, state).write.parquet(path)
        else:
            spark.read.parquet(f"{folder}/round-{turn - 1}").mapInArrow(go_on, state).write.parquet(path)
            drop_folder(spark, f"{folder}/round-{turn - 1}")
        sums = spark.read.parquet(path).select("totals").mapInArrow(add_up, schema)
        centroids, members, inertia = centroids.copy(), np.zeros(n_clusters, np.int64), np.zeros(n_clusters, np.int64)
        for r in sums.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names)).collect():
            members[r.cluster], inertia[r.cluster] = r.n, r.inertia
            if turn < rounds:
                centroids[r.cluster] = [r[c] // r.n for c in names[2:]]
    return Clustering(spark, path, centroids, members, inertia)


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every
    vector that :func:`cluster_vectors` keeps. The clusters, ``k`` at most, are broadcast."""
    found = cluster_vectors(df, id_col, vector_col, **settings)
    about = found.clusters().select(F.col("cluster").alias("c"), "cluster_inertia", "centroid_sha256")
    out = found.assignments("id").join(F.broadcast(about), F.col("cluster") == F.col("c"))
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(int(found.inertia.sum())).cast("long").alias("inertia"), "centroid_sha256")
