"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: first by its number of words, then by
its leading words. Words that hold a digit count as variable there. In the leaf
that it reaches, the other words are compared place by place: a word that many
lines of the leaf have at its place is part of the template, any other is a
variable field. Lines with equal templates form a group; groups found in many
different documents are boilerplate, and their lines are dropped.

The tree is never built in one place: a leaf is a hash, and leaves, words at
places and templates are counts over the whole corpus. A leaf or a template that
fills a third of the corpus is counted in parts before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, cut, words

#: Leading words that lead to a leaf.
DEPTH = 3
#: Different texts that a leaf and a template must be in, and lines of a leaf (copies
#: of one text counted once) that a word at its place must be in.
MIN_DOCS = 8
#: Share of a template's words that must be fixed.
FIXED = 0.6
#: Most keys of 8 bytes that are broadcast.
MAX_BROADCAST_KEYS = 1_000_000
FIELD = "<*>"
#: Shorter lines are no templates unless the caller says so: common words alone
#: would make them recur.
LEAST_WORDS = 4


def _masked(word: Column) -> Column:
    return F.when(word.rlike(r"\d"), F.lit(FIELD)).otherwise(word)


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc, line, leaf, words): each line of ``least_words`` words or more."""
    split = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.trim("raw", F.lit(SPACE_CHARS)) != "")
    found = split.select("doc", "line", words(F.col("raw")).alias("words")).where(F.size("words") >= least_words)
    lead = (F.coalesce(_masked(F.get("words", F.lit(k))), F.lit("")) for k in range(DEPTH))
    return found.select("doc", "line", F.xxhash64(F.size("words"), *lead).alias("leaf"), "words")


def _keys(df: DataFrame, key: str) -> DataFrame:
    """A set of keys, marked for broadcast if a count shows that it is small."""
    kept = cut(df.select(key))
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_KEYS else kept


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, fixed: float = FIXED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, line) of ``docs`` (doc, text): the lines of recurring templates."""
    lines = _lines(docs, least_words)
    in_docs = lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # Copies of one text have the same lines; each is one row from here on.
    own = cut(lines.join(_keys(in_docs, "leaf"), "leaf", "left_semi").distinct())
    placed = own.select("doc", "line", "leaf", F.posexplode("words").alias("place", "word"))
    placed = placed.withColumn("at", F.xxhash64("leaf", "place", "word"))
    frequent = _keys(placed.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "at").withColumnRenamed("at", "fixed_at")
    # Leading words have led to the leaf, so they are fixed unless they are masked.
    led = (F.col("place") < DEPTH) & ~F.col("word").rlike(r"\d")
    marked = placed.join(frequent, F.col("at") == F.col("fixed_at"), "left").withColumn("is_fixed", led | (F.col("fixed_at").isNotNull() & ~F.col("word").rlike(r"\d")))
    # A sum of hashes of the fixed words at their places names the template.
    part = F.when(F.col("is_fixed"), F.xxhash64("place", "word").cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    templates = _templates(marked.withColumn("part", part))
    recurring = templates.where(F.col("n_fixed") >= fixed * F.col("n_words"))
    wide = recurring.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return recurring.join(_keys(wide, "template"), "template", "left_semi").select("doc", "line")


def _templates(marked: DataFrame) -> DataFrame:
    """(doc, line, template, n_fixed, n_words) from one row a word."""
    grouped = marked.groupBy("doc", "line", "leaf").agg(F.sum("part").alias("total"), F.count_if("is_fixed").alias("n_fixed"), F.count("*").alias("n_words"))
    return grouped.select("doc", "line", F.xxhash64("leaf", "total").alias("template"), "n_fixed", "n_words")


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, fixed: float = FIXED, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_lines, n_dropped, text.

    ``n_lines`` counts the lines that have a word, ``n_dropped`` those dropped;
    ``text`` joins what is left, blank lines included. A line is dropped if its
    template is in ``min_docs`` different texts or more; copies of one text count
    once. Lines of fewer than ``least_words`` words stay. A null text stays null and
    has no lines, an empty one stays empty; texts of any length are read whole, and
    an empty table gives an empty result. Ids may be null or repeated: a row is
    known by the 128 bits of its text's MD5.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("doc", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = own.where("text is not null").select("doc", "text")
    dropped = recurring_lines(texts, min_docs, fixed, least_words).distinct().groupBy("doc").agg(F.collect_set("line").alias("gone"))
    # Cut, so that the join deals out both sides and Spark can split a text of many copies.
    out = own.join(cut(dropped), "doc", "left")
    split = F.split("text", "\n")
    has_word = F.filter(split, lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    # Places that stay, by one hash set; the lines are bound once and read by place.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    left = F.transform(F.array(split), lambda lines: F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))[0]
    return out.select(
        "doc_id",
        F.coalesce(F.size(has_word), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
