"""Near-duplicates by b-bit MinHash.

Each text becomes the set of its word shingles. Texts with equal sets form one
class and only classes go on, so exact copies cost one count however many
there are. For each class, minima of seeded hash functions over its set are

* grouped into bands: classes that agree on a whole band share a bucket and are
  candidates;
* cut to their low ``BITS`` bits and packed into bit planes: the number of
  agreeing places, corrected for places that agree by chance, estimates the
  similarity and discards candidates that are far below the threshold.

The full sets of what is left are compared, so every link is exact.

A bucket never emits all its pairs. Each class is first compared with its
bucket's leader, and connected classes become one component. After that only
classes of one bucket in different components matter:

* in buckets of up to ``SMALL`` classes such pairs are joined;
* larger buckets that overlap form a cluster, which is cut into blocks of up to
  ``BLOCK`` classes. Tasks compare two blocks by counting common shingles with a
  matrix product and return links between components only. Blocks inside one
  component are not compared.

Nothing is capped: both ways are exact for every pair that shares a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import counted_cut, cut, settled, words
from brindle.llm.components import components
from brindle.llm.tokens import constants, hashed_words, mix

#: A pair at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
#: Minima whose low bits are kept, and how many bits.
PACKED, BITS = 128, 2
#: A pair is discarded without comparing sets if its estimate is this far below
#: the threshold: six standard deviations of the estimate at 0.8.
MARGIN = 0.25
#: Classes of a bucket whose pairs are joined, and of a block of a larger one.
SMALL, BLOCK = 24, 512
#: Most ids that are broadcast (8 bytes each).
MAX_BROADCAST_IDS = 1_000_000

_SCHEMA = "doc_id long, n_shingles long, key binary, bands array<long>, bits array<long>"


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, in order."""
    factors = constants(size, 2)
    for part in hashed_words(column):
        h, ends = part.hashes, np.cumsum(part.counts)
        with np.errstate(over="ignore"):
            n = max(0, len(h) - size + 1)
            total = np.zeros(n, np.uint64)
            for k in range(size):
                total += h[k : k + n] * factors[k]
            shingles = mix(total)
            for end, count in zip(ends.tolist(), part.counts.tolist(), strict=True):
                if count >= size:
                    yield np.unique(shingles[end - count : end - size + 1])
                elif count:
                    short = (h[end - count : end] * factors[:count]).sum(dtype=np.uint64)
                    yield mix(np.array([short + np.uint64(count)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def _minima(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each hash function the least value over a set, in pieces."""
    least = np.full(len(low), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 2048):
        piece = own[k : k + 2048]
        a, b = piece.astype(np.uint32)[:, None], (piece >> np.uint64(32)).astype(np.uint32)[:, None]
        np.minimum(least, (a * low + b * high).min(axis=0), out=least)
    return least


def _planes(least: np.ndarray) -> list[int]:
    """Bit planes of the packed minima, as signed 64-bit words."""
    out: list[int] = []
    for bit in range(BITS):
        plane = np.packbits((least[:PACKED] >> np.uint32(bit)).astype(np.uint8) & 1, bitorder="little")
        out += plane.view(np.int64).tolist()
    return out


def _sign(size: int, n_bands: int, n_rows: int):
    """Arrow batches of (doc_id, text) -> signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = constants(max(n_bands * n_rows, PACKED), 3)
        low, high = seeds.astype(np.uint32) | np.uint32(1), (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        band = constants(n_rows, 4)
        salt = constants(n_bands, 5)
        for batch in settled(batches):
            count, keys, bands, bits = [], [], [], []
            with np.errstate(over="ignore"):
                for own in _sets(batch.column(1), size):
                    count.append(len(own))
                    # A strong digest of the sorted set: equal for equal sets only.
                    keys.append(hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest())
                    if len(own):
                        least = _minima(own, low, high)
                        banded = least[: n_bands * n_rows].astype(np.uint64).reshape(n_bands, n_rows)
                        bands.append(mix((banded * band).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                        bits.append(_planes(least))
                    else:
                        bands.append(np.zeros(0, np.int64))
                        bits.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "bands", "bits"],
            )

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, key, bands, bits) of each row.

    ``key``, a digest, is equal for equal sets. A text without words, or null, has an
    empty set, no bands and no bits.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_sign(size, n_bands, n_rows), T._parse_datatype_string(_SCHEMA))


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: agreeing places by bit counts, less
    those that agree by chance."""
    per = PACKED // 64
    agree = []
    for word in range(per):
        same = F.lit(-1).cast("long")
        for bit in range(BITS):
            k = bit * per + word
            same = same.bitwiseAND(F.bitwise_not(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))))
        agree.append(F.bit_count(same))
    chance = 1 / 2**BITS
    return (sum(agree[1:], agree[0]) / PACKED - chance) / (1 - chance)


def _shingles(text: Column, size: int):
    """The lower-case words of a text, and what makes their set of shingle hashes."""
    low = words(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return low, lambda w: F.array_distinct(
        F.when(
            F.size(w) >= size,
            F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))),
        ).otherwise(F.array(F.xxhash64(F.lit("short"), F.array_join(w, " "))))
    )


def _class_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(id, own): the sets of the classes in ``needed`` (id), from their texts.

    Ids are broadcast up to ``MAX_BROADCAST_IDS``, counted first; above it,
    texts are shuffled to them.
    """
    needed, n = counted_cut(needed)
    low, build = _shingles(F.col("text"), size)
    ids = F.broadcast(needed) if n <= MAX_BROADCAST_IDS else needed
    picked = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
    return cut(picked.select(F.col("doc_id").alias("id"), low.alias("w")).where(F.size("w") > 0).select("id", build(F.col("w")).alias("own")))


def _near(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that bit counts do not discard."""
    a_bits, b_bits = (bits.select(F.col("rep").alias(x), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    close = estimate(F.col("a_bits"), F.col("b_bits")) >= percent / 100 - MARGIN
    return pairs.join(a_bits, "a").join(b_bits, "b").where(close).select("a", "b")


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = near.join(sets.select(F.col("id").alias("a"), F.col("own").alias("a_own")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("b_own")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("a_own", "b_own")).cast("long").alias("common"), (F.size("a_own") + F.size("b_own")).alias("total"))
    return counted.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _block_links(percent: int):
    """Two blocks of one cluster -> one link between each two components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
        own = [np.asarray(x, np.int64) for x in pdf["own"]]
        sizes = np.array([len(x) for x in own])
        rows = np.repeat(np.arange(len(own)), sizes)
        values, place, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        # A shingle that one text holds adds to no intersection.
        shared = np.flatnonzero(n > 1)
        column = np.full(len(values), -1)
        column[shared] = np.arange(len(shared))
        place = column[place]
        order = np.argsort(place, kind="stable")
        place, rows = place[order], rows[order]
        left, right = (np.flatnonzero(pdf["side"].to_numpy() != k) for k in (1, 0))
        common = np.zeros((len(left), len(right)), np.float32)
        for first in range(0, len(shared), 4096):
            low, high = np.searchsorted(place, [first, first + 4096])
            dense = np.zeros((len(own), min(4096, len(shared) - first)), np.float32)
            dense[rows[low:high], place[low:high] - first] = 1
            common += dense[left] @ dense[right].T
        total = sizes[left][:, None] + sizes[right][None, :]
        comp_a, comp_b = a["comp"].to_numpy(), b["comp"].to_numpy()
        i, j = np.nonzero((100 * common >= percent * (total - common)) & (comp_a[:, None] != comp_b[None, :]))
        found = pd.DataFrame({"a": a["id"].to_numpy()[i], "b": b["id"].to_numpy()[j], "x": np.minimum(comp_a[i], comp_b[j]), "y": np.maximum(comp_a[i], comp_b[j])})
        return found.drop_duplicates(["x", "y"])[["a", "b"]]

    return run


def _large(buckets: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside the clusters of large buckets."""
    stars = buckets.select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    members = components(stars).withColumnRenamed("component", "cluster")
    members = members.join(comps.select("id", F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # Components of half a block or more have blocks of their own; the rest share.
    n_comp = members.groupBy("cluster", "comp").agg(F.count("*").alias("n")).withColumn("of", F.when(F.col("n") * 2 >= BLOCK, F.col("comp")))
    n_of = n_comp.groupBy("cluster", "of").agg(F.sum("n").alias("n"), F.count("*").alias("comps")).select("cluster", F.col("of").alias("g_of"), F.ceil(F.col("n") / BLOCK).alias("blocks"), "comps")
    placed = n_comp.select(F.col("cluster").alias("c"), F.col("comp").alias("m"), "of").join(n_of, (F.col("c") == F.col("cluster")) & F.col("of").eqNullSafe(F.col("g_of"))).select("c", "m", "of", "blocks")
    placed = members.join(placed, (F.col("cluster") == F.col("c")) & (F.col("comp") == F.col("m"))).select("id", "cluster", "comp", "of", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("part"))
    placed = cut(placed.withColumn("block", F.struct(F.coalesce("of", F.lit(-(1 << 63))).alias("of"), F.col("part").alias("part"))))
    blocks = placed.select("cluster", "block", "of").distinct()
    x = blocks.select("cluster", F.col("block").alias("i"), F.col("of").alias("i_of"))
    y = blocks.select(F.col("cluster").alias("c"), F.col("block").alias("j"), F.col("of").alias("j_of"))
    pairs = x.join(y, (F.col("cluster") == F.col("c")) & (F.col("i") <= F.col("j"))).where(~F.coalesce(F.col("i_of") == F.col("j_of"), F.lit(False))).select("cluster", "i", "j")
    sides = pairs.select("cluster", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("block", F.when(F.col("side") == 1, F.col("j")).otherwise(F.col("i")))
    rows = placed.join(sides, ["cluster", "block"]).join(sets, "id").select("cluster", "i", "j", "side", "id", "comp", "own")
    return rows.groupBy("cluster", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def links(signed: DataFrame, docs: DataFrame, size: int = 2, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(reps, classes): (key, rep) of every class, and (id, component) of linked ones.

    ``signed`` is what :func:`signatures` returns, already materialised.
    """
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = cut(full.groupBy("key").agg(F.min("doc_id").alias("rep")))
    first = full.join(reps.select(F.col("key").alias("k"), "rep"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("rep"))).select("rep", "bands", "bits")
    first = cut(first.dropDuplicates(["rep"]))
    bits = first.select("rep", "bits")
    banded = first.select("rep", F.explode("bands").alias("band"))
    # Cut, as below: so the join deals out both sides anew and Spark can split a hot bucket.
    shared = cut(banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    buckets = cut(banded.join(shared, "band"))
    stars = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    sets = _class_sets(docs, buckets.select(F.col("rep").alias("id")).distinct(), size)
    comps = components(_confirmed(_near(stars, bits, percent), sets, percent))
    # What is left to compare: buckets whose classes are in different components.
    labelled = buckets.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    open_ = cut(labelled.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band"))
    rest = cut(labelled.join(open_, "band", "left_semi"))
    small = rest.where(F.col("n").between(3, SMALL))
    a, b = (small.select("band", F.col("rep").alias(x), F.col("comp").alias(f"{x}_comp")) for x in "ab")
    pairs = a.join(b, "band").where("a < b and a_comp <> b_comp").select("a", "b").distinct()
    more = _confirmed(_near(pairs, bits, percent), sets, percent)
    large = rest.where(F.col("n") > SMALL)
    if not large.isEmpty():
        more = more.union(_large(large, comps, sets, percent))
    # The new links join whole components; only those are gone through again.
    own = lambda x: comps.select(F.col("id").alias(x), F.col("component").alias(f"{x}_comp"))
    ends = more.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    merged = components(ends)
    both = comps.select(F.col("id"), F.col("component").alias("c")).join(merged.select(F.col("id").alias("c"), "component"), "c", "left").select("id", F.coalesce("component", "c").alias("component"))
    # A class without an earlier component is named by its own id in the merge.
    alone = merged.join(comps.select("id"), "id", "left_anti")
    classes = both.unionByName(alone)
    return reps, classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * |intersection| >= ``percent`` * |union| of their
    sets of ``size``-word shingles (A-Z in lower case; a shorter text is one
    shingle). ``component_id`` is the smallest doc_id reached by links; ``kept``
    marks it. A null text or one without words links with nothing. A row
    with a null id links with nothing, has no component and is kept. Rows of one
    id are one document: equal rows share a component, and if their texts differ
    the links of both count for the one that represents its class. ``n_bands``
    bands of ``n_rows`` minima choose the candidates. Texts of any length are read
    whole; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(signatures(own, size=size, n_bands=n_bands, n_rows=n_rows))
    reps, classes = links(signed, own, size, percent)
    top = reps.join(classes, F.col("rep") == F.col("id"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(top, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, **options: int) -> DataFrame:
    """``docs`` with one document of each component, its columns unchanged.

    Rows of the kept id stay, all of them if it is repeated, and so do rows
    with a null id. The ids to drop are broadcast to the texts up to
    ``MAX_BROADCAST_IDS``, counted first; beyond that both are shuffled.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent, **options)
    gone, n = counted_cut(found.where("not kept").select(F.col("doc_id").alias("__brindle_gone")).distinct())
    gone = F.broadcast(gone) if n <= MAX_BROADCAST_IDS else gone
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__brindle_gone"), "left_anti")
