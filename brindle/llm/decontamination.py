"""Benchmark decontamination by spaced-seed hashing.

A mask names the places of a window that count; the others are ignored. Every
window of every benchmark item and of every document is hashed once for each
mask, and equal hashes are seeds. A substituted word breaks the masks that look
at its place and no others, so a passage with scattered substitutions still
has seeds. Around each seed the item and the document are compared place by
place; enough equal words in that window make the document contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut

#: Places that each mask looks at, in a window of SPAN words.
MASKS = ((0, 1, 2, 4, 7, 9, 10), (0, 1, 3, 4, 6, 8, 9), (0, 2, 3, 5, 7, 8, 10))
SPAN = 11
#: Words compared around a seed, and the percentage of them that must be equal.
WINDOW = 15
IDENTITY = 80
#: Words before a seed's place that a window can reach.
LEAD = WINDOW - SPAN
#: Most benchmark seeds that are broadcast, and their bytes; above either, they are shuffled.
MAX_BROADCAST_SEEDS = 2_000_000
MAX_BROADCAST_BYTES = 128 << 20
#: Bytes of a seed's row beside its item's id.
SEED_BYTES = 8 * (WINDOW + 12)
#: Most contaminated documents whose ids are broadcast.
MAX_BROADCAST_IDS = 1_000_000


def hashed_words(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits; null: none."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame) -> DataFrame:
    """``df`` (with ``th``), one row per window and mask: ``pos`` and ``seed``.

    The outer form of explode keeps Spark from adding a filter that would
    build the words a second time.
    """
    at = df.select("*", F.posexplode_outer("th").alias("pos", "__h")).drop("__h").where(F.col("pos") <= F.size("th") - SPAN)
    masks = (F.xxhash64(F.lit(k), *(F.get("th", F.col("pos") + o) for o in mask)) for k, mask in enumerate(MASKS))
    return at.select("*", F.explode(F.array(*masks)).alias("seed"))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, seed, lead, theirs, times): of each seed only the words to compare,
    how many of them lie before its place, and how often the item has it.

    A text that repeats itself has few different seeds, so a document that does
    so too meets each of its places with those few, not with every place.
    """
    n = F.least(F.lit(WINDOW), F.size("th"))
    first = F.greatest(F.lit(0), F.least(F.col("pos") - LEAD // 2, F.size("th") - n))
    found = _seeds(items).select("item_id", "seed", (F.col("pos") - first).alias("lead"), F.slice("th", first + 1, n).alias("theirs"))
    return found.groupBy("item_id", "seed", "lead", "theirs").agg(F.count("*").alias("times"))


def _near(hit: DataFrame) -> DataFrame:
    """The words of ``th`` that a window around ``pos`` can reach, and the place in them."""
    first = F.greatest(F.lit(0), F.col("pos") - LEAD)
    return hit.select("doc_id", "seed", F.slice("th", first + 1, LEAD + WINDOW).alias("th"), (F.col("pos") - first).alias("pos"))


def _windows(hit: DataFrame) -> DataFrame:
    """Of each seed only the words to compare: ``own`` and ``theirs``, aligned.

    Slices run in the generated code of the join, so the words of a whole
    document never leave it with a hit, and that code stays small enough for the
    JVM to compile.
    """
    n = F.size("theirs")
    # Words of the window that would lie before the document's first one.
    before = F.greatest(F.lit(0), F.col("lead") - F.col("pos"))
    own = F.slice("th", F.col("pos") - F.col("lead") + before + 1, n - before)
    return hit.select("doc_id", "item_id", "times", n.alias("window"), own.alias("own"), F.slice("theirs", before + 1, n - before).alias("theirs"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_seeds, identity): each verified pair once.

    ``identity`` is the largest percentage of equal words in a window around a
    seed. Documents or items of fewer than ``SPAN`` words, and null or empty
    texts, have no windows and match nothing. Rows of one id (null included)
    count as one document. Documents are not shuffled unless the benchmark has
    more than ``MAX_BROADCAST_SEEDS`` seeds or ``MAX_BROADCAST_BYTES`` of them,
    which is counted first; repeated seeds, passages or documents only add rows
    to a partial aggregation. What is shuffled beyond that is a row of at most
    ``LEAD + WINDOW`` words for each window and mask, whatever the text's length.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), hashed_words(F.col(item_text_col)).alias("item_th")).where(F.size("item_th") >= SPAN).distinct()
    seeds = _item_seeds(items.withColumnRenamed("item_th", "th"))
    own_seeds = (F.size("item_th") - SPAN + 1).cast("long") * len(MASKS)
    id_bytes = F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))
    n, n_bytes = items.agg(F.sum(own_seeds), F.sum(own_seeds * (id_bytes + SEED_BYTES))).first()
    own = docs.select(F.col(id_col).alias("doc_id"), hashed_words(F.col(text_col)).alias("th"))
    if (n or 0) <= MAX_BROADCAST_SEEDS and (n_bytes or 0) <= MAX_BROADCAST_BYTES:
        hit = _seeds(own).join(F.broadcast(seeds), "seed")
    else:
        # Cut, so that both sides are dealt out by seed alone and Spark splits the windows of
        # a seed that very many documents have over as many tasks as they fill.
        hit = _near(_seeds(own)).join(cut(seeds).hint("merge"), "seed")
    both = F.sequence(F.lit(0), F.least(F.size("own"), F.size("theirs")) - 1)
    equal = F.size(F.filter(both, lambda k: F.get("own", k) == F.get("theirs", k)))
    compared = _windows(hit).select("doc_id", "item_id", "times", (100.0 * equal / F.col("window")).alias("identity"))
    # Filtered after the aggregation, so that the comparison stays out of the join.
    best = compared.groupBy("doc_id", "item_id").agg(F.coalesce(F.sum(F.when(F.col("identity") >= IDENTITY, F.col("times"))), F.lit(0)).cast("long").alias("n_seeds"), F.max("identity").alias("identity"))
    return best.where("n_seeds > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, n_seeds, identity,
    items (the ids of the items it overlaps, comma-joined in order).

    Rows of one id count as one document, those with a null id as one too; null,
    empty and short texts give no row, and neither do empty tables.
    """
    return (
        overlaps(docs, benchmark, **columns)
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_items"),
            F.sum("n_seeds").alias("n_seeds"),
            F.max("identity").alias("identity"),
            F.array_join(F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` without the contaminated documents, its columns unchanged.

    Rows of one id are one document and go together; a row without an id is
    known by its text, so only such rows that hold a passage go. Null, empty and
    short texts stay, and an empty benchmark removes nothing. The ids to remove are
    broadcast if a count shows that they are few; then no text is shuffled.
    """
    key = F.coalesce(F.concat(F.lit("id:"), F.col(f"`{id_col}`").cast("string")), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))))
    own = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    bad = cut(overlaps(own, benchmark, id_col="key", text_col="text", **columns).select(F.col("doc_id").alias("__brindle_bad")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= MAX_BROADCAST_IDS else bad, key == F.col("__brindle_bad"), "left_anti")
