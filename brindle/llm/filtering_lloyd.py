"""Vector code compression: product codes whose codebooks are learnt by filtering Lloyd.

Vectors are cut into equal parts, each part position has a codebook, and a
vector's code names the nearest entry of every part. Codebooks are learnt by
Lloyd rounds over kd-trees: every block of a partition holds one balanced tree
a part position, with the bounding box, the sum and the count of the parts below
each node. A round walks the trees from their roots with a set of candidate
entries: an entry that is farther than another from every point of a node's box
is eliminated, and a node with one candidate left is assigned as a whole, by its
cached sum and count. Only parts in leaves that several candidates reach are
compared one by one.

The trees are built once, written to the shared folder and read in every round;
what a round returns is one sum and count an entry, and the codebooks (of a
fixed size) are all that the driver holds. All numbers are integers, so results
do not depend on how the vectors are dealt out.
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

from brindle.llm.common import cut, scratch_folder
from brindle.llm.vectors import finite, integers, number_type, pack, shrunk, slices, unpack

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Most parts of a leaf.
LEAF = 32
#: Nodes whose boxes are held against the entries together.
TOGETHER = 64
#: Most different labels whose sums are broadcast.
MAX_BROADCAST_LABELS = 1_000_000

_TREE = ("points", "order", "low", "high", "sums")


@dataclass
class Shape:
    """The nodes of a balanced tree over ``n`` places, root first; they depend on n alone."""

    first: np.ndarray
    last: np.ndarray
    #: The left child; the right one is next to it. -1: a leaf.
    child: np.ndarray


def shape(n: int) -> Shape:
    first, last, child, k = [0], [n], [], 0
    while k < len(first):
        size = last[k] - first[k]
        child.append(len(first) if size > LEAF else -1)
        if size > LEAF:
            middle = first[k] + size // 2
            first += [first[k], middle]
            last += [middle, last[k]]
        k += 1
    return Shape(np.array(first), np.array(last), np.array(child))


def build(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high, sums) of the kd-tree of ``parts`` (n, d): the places of
    the parts from leaf to leaf, and every node's box and sum. A node is halved
    at the median of its widest side."""
    nodes, order = shape(len(parts)), np.arange(len(parts))
    low, high, sums = (np.zeros((len(nodes.first), parts.shape[1]), np.int64) for _ in range(3))
    for k, (first, last, child) in enumerate(zip(nodes.first, nodes.last, nodes.child, strict=True)):
        own = parts[order[first:last]]
        low[k], high[k], sums[k] = own.min(axis=0), own.max(axis=0), own.sum(axis=0)
        if child >= 0:
            side = int(np.argmax(high[k] - low[k]))
            order[first:last] = order[first:last][np.argpartition(own[:, side], nodes.last[child] - first)]
    return order, low, high, sums


class Walk:
    """One codebook with what the walks of many trees share."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        self.typed: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def tables(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, their squared lengths, and |entry - entry| side by side."""
        if kind not in self.typed:
            z = self.book.astype(kind)
            self.typed[kind] = z, (z * z).sum(axis=1), np.abs(z[:, None] - z[None])
        return self.typed[kind]

    def assign(self, parts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, entry) of subtrees assigned as a whole, and the entry of each
        other part (``parts`` in leaf order), -1 for those in such subtrees."""
        nodes = shape(len(parts))
        kind = number_type(parts.shape[1], parts, self.book)
        z, norms, apart = self.tables(kind)
        # Twice the middle and twice half the width keep the numbers whole.
        middle, width = (low + high).astype(kind), (high - low).astype(kind)
        entry, whole_nodes = np.full(len(parts), -1), []
        level, alive = np.array([0]), np.ones((1, len(z)), bool)
        index = np.arange(len(z))
        while len(level):
            for at in range(0, len(level), TOGETHER):
                some, own = level[at : at + TOGETHER], alive[at : at + TOGETHER]
                score = norms - middle[some] @ z.T
                best = np.argmin(np.where(own, score, np.iinfo(np.int64).max if kind is np.int64 else np.inf), axis=1)
                spread = np.matmul(apart[best], width[some][:, :, None])[:, :, 0]
                # How much farther an entry is than the best one at the corner that favours it most.
                margin = score - score[np.arange(len(some)), best][:, None] - spread
                own &= (margin < 0) | ((margin == 0) & (index <= best[:, None]))
            one = alive.sum(axis=1) == 1
            whole_nodes += zip(level[one].tolist(), np.argmax(alive[one], axis=1).tolist(), strict=True)
            for node, own in zip(level[~one], alive[~one], strict=True):
                if nodes.child[node] < 0:
                    leaf = slice(nodes.first[node], nodes.last[node])
                    candidates = np.flatnonzero(own)
                    distance = norms[candidates] - 2 * (parts[leaf].astype(kind) @ z[candidates].T)
                    entry[leaf] = candidates[np.argmin(distance, axis=1)]
            inner = ~one & (nodes.child[level] >= 0)
            child = nodes.child[level[inner]]
            level = np.stack([child, child + 1], axis=1).ravel()
            alive = np.repeat(alive[inner], 2, axis=0)
        return np.array(whole_nodes, np.int64).reshape(-1, 2), entry


def _sums(parts: np.ndarray, sums: np.ndarray, subtrees: np.ndarray, entry: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums (k, d), counts (k)) of one tree."""
    nodes = shape(len(parts))
    total, count = np.zeros((k, parts.shape[1]), np.int64), np.zeros(k, np.int64)
    np.add.at(total, subtrees[:, 1], sums[subtrees[:, 0]].astype(np.int64))
    np.add.at(count, subtrees[:, 1], (nodes.last - nodes.first)[subtrees[:, 0]])
    left = np.flatnonzero(entry >= 0)
    np.add.at(total, entry[left], parts[left].astype(np.int64))
    return total, count + np.bincount(entry[left], minlength=k)


class _Block:
    """The trees of one written block."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.points = unpack(row["points"])
        self.order, self.low, self.high, self.sums = (unpack(row[c]) for c in _TREE[1:])

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(parts in leaf order, their places, low, high, sums)."""
        d = self.points.shape[1] // len(self.order)
        return self.points[self.order[p], p * d : (p + 1) * d], self.order[p], self.low[p], self.high[p], self.sums[p]


@dataclass
class Codebooks:
    """Entries (parts, entries, d); a vector's code has an index into each part's."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector that a code stands for, scaled as the entries are."""
        return [int(x) for p, part in enumerate(self.entries) for x in part[int(code[2 * p : 2 * p + 2], 16)]]


@dataclass
class Forest:
    """Written blocks of vectors with their trees, and the vectors that start the codebooks."""

    spark: object
    path: str
    first: np.ndarray
    parts: int


def plant(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Forest:
    """Write the trees of all kept vectors of ``df`` in blocks; one pass, no shuffle.

    A vector is kept unless it is null or holds a component that is null or not
    finite. The codebooks start as the kept vectors of the ``entries`` smallest
    ids (ties by the vector, null ids last) that can be cut: their length is that
    of the smallest id whose length is a positive multiple of ``parts``. Kept
    vectors of other lengths cannot be cut and come out without a code.
    Other columns are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("parts must be positive and entries from 1 to 256: an entry is two hex digits")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(finite(F.col("v")))
    by_id = rows.orderBy(F.col("id").asc_nulls_last(), "v")
    lead = by_id.where((F.size("v") > 0) & (F.size("v") % parts == 0)).select(F.size("v").alias("n")).first()
    size = lead.n if lead else 0
    start = by_id.where(F.size("v") == size).select("v").limit(entries).collect() if size else []
    first = integers(pa.array([r.v for r in start], pa.list_(pa.float64())), scale).reshape(-1, max(size, 1))
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), *(T.StructField(c, T.BinaryType()) for c in _TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fits = batch.column("fits").to_numpy(zero_copy_only=False).astype(bool)
            for own in (True, False):
                some = batch.filter(pa.array(fits == own))
                if not some.num_rows:
                    continue
                trees: list[bytes | None] = [None] * len(_TREE)
                if own:
                    points = integers(some.column("v"), scale)
                    d = size // parts
                    found = [build(points[:, p * d : (p + 1) * d]) for p in range(parts)]
                    trees = [pack(shrunk(points)), *(pack(shrunk(np.stack(x))) for x in zip(*found, strict=True))]
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in trees)], ["ids", "labels", *_TREE])

    path = scratch_folder(df.sparkSession, "forest") + "/trees"
    rows.withColumn("fits", F.size("v") == size if size else F.lit(False)).mapInArrow(run, schema).write.parquet(path)
    return Forest(df.sparkSession, path, first, parts)


def fit(forest: Forest, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all trees: every part goes to the
    nearest entry (ties to the lower one), then every entry becomes the floor of
    the mean of its parts; unused entries stay. No vectors: no entries."""
    spark, parts = forest.spark, forest.parts
    k, d = len(forest.first), forest.first.shape[1] // parts
    books = forest.first.reshape(k, parts, d).transpose(1, 0, 2).copy()
    names = [f"s{i}" for i in range(d)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", *names))])
    for _ in range(rounds if k else 0):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            walks = [Walk(b) for b in shared.value]
            total, count = np.zeros(shared.value.shape, np.int64), np.zeros(shared.value.shape[:2], np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    block = _Block(row)
                    for p, walk in enumerate(walks):
                        points, _, low, high, sums = block.part(p)
                        more, n = _sums(points, sums, *walk.assign(points, low, high), k=len(walk.book))
                        total[p] += more
                        count[p] += n
            part, entry = np.nonzero(count)
            columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.fieldNames())

        trees = spark.read.parquet(forest.path).where("points is not null").select(*_TREE)
        for r in trees.mapInArrow(run, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect():
            books[r.part, r.entry] = [r[c] // r.n for c in names]
        shared.unpersist()
    return Codebooks(books)


def encode(forest: Forest, books: Codebooks, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every kept vector: two hex digits a part, and
    its squared distances summed. Both are null for vectors that cannot be cut."""
    spark = forest.spark
    blocks = spark.read.parquet(forest.path)
    id_type, label_type = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))
    names = (id_col, label_col, "code", "error")
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, (id_type, label_type, T.StringType(), T.LongType()), strict=True)])
    shared = spark.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(b) for b in shared.value]
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = (batch.column(c)[at].values for c in ("ids", "labels"))
                n = len(ids)
                code, error = pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())
                if batch.column("points")[at].is_valid:
                    block = _Block({c: batch.column(c)[at].as_py() for c in _TREE})
                    found, far = np.zeros((n, len(walks)), np.uint8), np.zeros(n, np.int64)
                    for p, walk in enumerate(walks):
                        points, order, low, high, _ = block.part(p)
                        nodes = shape(n)
                        subtrees, entry = walk.assign(points, low, high)
                        for node, e in subtrees:
                            entry[nodes.first[node] : nodes.last[node]] = e
                        found[order, p] = entry
                        far[order] += ((points.astype(np.int64) - walk.book[entry]) ** 2).sum(axis=1)
                    code, error = pa.array([bytes(c).hex() for c in found], pa.string()), pa.array(far)
                yield pa.RecordBatch.from_arrays([ids, labels, code, error], list(names))

    return blocks.mapInArrow(run, schema)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every kept vector.

    ``label_error`` sums the errors of equal labels, nulls together. Repeated
    rows and null ids come out as often as they go in; an empty table, or one
    without a kept vector, gives no rows. See :func:`plant` for what is kept. A component so large that squared distances leave
    64 bits is an error.
    """
    forest = plant(df, id_col, vector_col, label_col, parts, entries, scale)
    books = fit(forest, rounds)
    coded = cut(encode(forest, books, "id", "label"))
    sums = cut(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    few = F.broadcast(sums) if sums.count() <= MAX_BROADCAST_LABELS else sums
    joined = coded.join(few, F.col("label").eqNullSafe(F.col("l")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
