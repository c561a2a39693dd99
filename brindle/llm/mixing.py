"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, shuffled by a hash, form one stream of words that is
repeated as often as its target needs. The stream is cut into blocks of equal
numbers of words. A golden-ratio sequence is mapped through the cumulative target
shares to one source per slot, so every stretch of the schedule holds the sources
in about their shares; the k-th slot of a source is joined with the k-th block
of its stream. What a document gives to the mix, how often, and where in the mix
its copies stand, all come from that join.

Sums over a source's documents are made in two steps (hash ranges, then
documents of one range), so a source with a third of all rows is spread out;
so are the sums over sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, words

#: Words of a block.
BLOCK = 1024
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most uses of a source.
SHARE, MOST = 1.5, 2
#: Documents of a source, on average, whose places are summed together.
TOGETHER = 1 << 16
#: Cells of the unit interval for the slot join.
CELLS = 4096
#: Consecutive slots that are ranked together, and sources that are summed together.
STRETCH = 1 << 16
#: Most sources that are broadcast.
MAX_BROADCAST_SOURCES = 100_000
#: floor(2**32 / golden ratio), odd.
_STEP = 2654435769


def golden(i: Column) -> Column:
    """The i-th point of the golden-ratio sequence, as a whole number of 2**-32."""
    low, high = i.bitwiseAND(F.lit(0xFFFF)), F.shiftright(i, 16).bitwiseAND(F.lit(0xFFFF))
    top = F.pmod(high * F.lit(_STEP), F.lit(1 << 16)) * F.lit(1 << 16)
    return F.pmod(low * F.lit(_STEP) + top, F.lit(1 << 32))


def _before(df: DataFrame, value: Column, part: str, order: Sequence[str | Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows (of ``by``).

    Rows are in the order of ``part``, then ``order``: sums of whole parts
    first, then sums inside one part.
    """
    sums = df.groupBy(*by, part).agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(base, [*by, part]).withColumn(name, (F.col("__base") + F.col("__inside")).cast("long")).drop("__base", "__inside")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, k, source_size, n_rows, target): one row a source, null last.

    Each source gets its weight's part of ``share`` times all words, at most
    ``most`` times its own; the excess goes to the others by weight until none is
    above its bound. Sources reach their bounds in the order of the bound over the
    weight, so sums over the sources before each one in that order tell at once
    from where on sources share what is left.
    """
    by_source = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    # Ranges of sources, numbered in order; cut, so that the ranges stay as they are.
    ranged = cut(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    ranked = _before(ranged, F.lit(1), "part", [F.col("source").asc_nulls_last()], "k").drop("part")
    weight = F.get(F.array(*(F.lit(int(x)) for x in weights)), (F.col("k") % len(weights)).cast("int")).cast("long")
    ranked = cut(ranked.withColumn("w", weight).withColumn("ratio", most * F.col("source_size") / F.col("w")))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    by_ratio = cut(ranked.repartitionByRange("ratio", "k").withColumn("part", F.spark_partition_id()))
    summed = _before(_before(by_ratio, F.col("source_size"), "part", ["ratio", "k"], "size_before"), F.col("w"), "part", ["ratio", "k"], "w_before")
    # What a unit of weight gets if the sources before this one are at their bounds.
    level = (F.lit(share * (total or 0)) - most * F.col("size_before")) / (F.lit(all_weights or 0) - F.col("w_before"))
    first = summed.withColumn("level", level).where(F.col("level") <= F.col("ratio")).agg(F.min_by("level", F.struct("ratio", "k"))).first()[0]
    bound = most * F.col("source_size").cast("double")
    target = bound if first is None else F.least(bound, F.col("w") * F.lit(float(first)))
    return ranked.select("source", "k", "source_size", "n_rows", target.alias("target"))


def takes() -> Column:
    """A source's target in whole words."""
    return F.round("target").cast("long")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k, rank, slot): the slot of the rank-th block of each source.

    ``sources``: (k, target), materialised. Slots past what a source needs are
    passed over; where the sequence gives a source too few (it is off by a few
    slots at most), they follow at the end, by rank. Each block has one slot.
    """
    spark = sources.sparkSession
    need = sources.select("k", takes().alias("takes"), F.ceil(takes() / F.lit(block)).alias("need")).withColumn("part", F.floor(F.col("k") / STRETCH))
    count, n, total = need.agg(F.count("*"), F.sum("need"), F.sum("takes")).first()
    n, total = int(n or 0), int(total or 0) or 1
    # Whole numbers: the place of a share's end times the words of all, over 2**32.
    at = lambda words: F.expr(f"cast(cast({words} as decimal(20,0)) * 4294967296 div {total} as long)")
    spans = _before(need, F.col("takes"), "part", ["k"], "before").withColumn("upto", F.col("before") + F.col("takes"))
    spans = spans.select("k", "need", at("before").alias("low"), at("upto").alias("high")).where("high > low")
    width = (1 << 32) // CELLS
    cells = spans.select("*", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    cells = F.broadcast(cells) if count <= MAX_BROADCAST_SOURCES else cells
    points = spark.range(n).select(F.col("id").alias("slot"), golden(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    mapped = points.join(cells, "cell").where("u >= low and u < high").select("slot", "k", "need", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    ranked = _before(mapped, F.lit(1), "stretch", ["slot"], "rank", by=["k"]).where("rank < need").select("k", "rank", "slot")
    got = mapped.groupBy("k").agg(F.count("*").alias("got"))
    short = need.join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    late = short.select("k", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank")).withColumn("part", F.floor(F.col("rank") / 64))
    late = _before(late, F.lit(1), "part", ["rank", "k"], "late").select("k", "rank", (F.lit(n) + F.col("late")).alias("slot"))
    return ranked.unionByName(late)


def _key(id_col: str, text_col: str, seed: int) -> Column:
    """What a row is known and shuffled by; equal for equal ids and texts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).cast("binary"))


def _starts(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): each row of ``docs`` with its key, size, source's row, and
    ``starts``, its places in the source's repeated stream that the target reaches."""
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.size(words(F.col(f"`{text_col}`").cast("string"))).cast("long").alias("size"), _key(id_col, text_col, seed).alias("key"),
    )
    sized = cut(sized)
    sources = cut(targets(sized, weights, share, most))
    n_sources, largest = sources.agg(F.count("*"), F.max("n_rows")).first()
    known = sources.withColumnRenamed("source", "__source").drop("n_rows")
    known = F.broadcast(known) if n_sources <= MAX_BROADCAST_SOURCES else known
    keyed = sized.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # More ranges for more rows; the order, by key, does not depend on how many.
    digits = 3
    while 16**digits * TOGETHER < (largest or 0):
        digits += 1
    placed = _before(keyed.withColumn("range", F.substring("key", 1, digits)), F.col("size"), "range", ["key", "doc_id", "size"], "at", by=["k"])
    turns = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("at") + e * F.col("source_size"))
    reached = F.filter(turns, lambda start: start < F.col("takes"))
    placed = placed.withColumn("takes", takes()).select("doc_id", "key", "k", "size", "source_size", "target", "takes", reached.alias("starts"))
    return cut(placed.withColumn("row", F.monotonically_increasing_id())), sources


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken,
    copies, first_slot.

    ``taken`` is how many of the document's words the scheduled blocks hold,
    repeats counted; ``copies`` how often the document starts in them;
    ``first_slot`` the earliest slot that holds a part of it (null: none). A
    null text has no words. A null source is a source of its own. A document
    without words is taken as 0 and has a copy where its place in the stream is
    taken. Rows of one id keep their own rows. A very long text lies in many blocks,
    a row each. Reruns agree: the order is by hash of ``seed``, id and text. An
    empty table gives an empty result.
    """
    placed, sources = _starts(docs, id_col, text_col, source_col, weights, share, most, seed)
    turns = placed.select("row", "k", "size", "takes", F.explode("starts").alias("start"))
    end = F.least(F.col("start") + F.col("size"), F.col("takes"))
    # A document without words lies in the block of its place.
    last = F.floor((F.greatest(end, F.col("start") + 1) - 1) / block)
    parts = turns.withColumn("end", end).select("*", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("rank"))
    joined = parts.join(schedule(sources, block), ["k", "rank"])
    overlap = F.least("end", (F.col("rank") + 1) * block) - F.greatest("start", F.col("rank") * block)
    given = joined.groupBy("row").agg(
        F.sum(overlap).alias("taken"),
        F.count_if(F.floor(F.col("start") / block) == F.col("rank")).alias("copies"),
        F.min("slot").alias("first_slot"),
    )
    none = F.lit(0).cast("long")
    return placed.join(given, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("copies", none).alias("copies"), "first_slot")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", in_order: bool = True, block: int = BLOCK, seed: int = 1, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with every row as often as scheduled blocks hold its start, its
    columns unchanged.

    ``in_order``: the rows come in the order of their slots, places within a
    slot in that of the stream; this shuffles the texts once more. Rows of one
    id and text share the largest number of copies. Null texts and sources,
    long texts and empty tables are as for :func:`mix`.
    """
    placed, sources = _starts(docs, id_col, text_col, source_col, weights, share, most, seed)
    turns = placed.select("row", "key", "k", F.explode("starts").alias("start")).withColumn("rank", F.floor(F.col("start") / block))
    slotted = turns.join(schedule(sources, block), ["k", "rank"])
    by_row = slotted.groupBy("row", "key").agg(F.sort_array(F.collect_list(F.struct("slot", "start"))).alias("at"))
    by_key = by_row.groupBy("key").agg(F.max(F.struct(F.size("at").alias("n"), "at"))["at"].alias("__brindle_at")).withColumnRenamed("key", "__brindle_key")
    # Keys dealt out evenly first, so that the join deals out both sides itself and Spark can
    # split a text of many rows.
    spread = by_key.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = docs.join(spread, _key(id_col, text_col, seed) == F.col("__brindle_key"))
    out = both.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode("__brindle_at").alias("__brindle_at"))
    if in_order:
        out = out.repartitionByRange("__brindle_at").sortWithinPartitions("__brindle_at")
    return out.drop("__brindle_at")
