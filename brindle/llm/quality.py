"""Quality rules: a threshold table compiled into one Spark projection.

Each text becomes a row of counts, the counts become ratios, and every row of
the threshold table becomes one comparison. All of it is built-in functions on
the row itself, so there is no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, words

#: Common function words of the four languages that the corpus holds.
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "a", "for", "on", "as", "it", "was", "at", "by", "this", "from", "or", "an", "are"),
    *("der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "mit", "von", "auf", "des", "dem", "sich", "nicht", "auch", "im"),
    *("le", "la", "les", "un", "une", "des", "et", "est", "que", "qui", "de", "du", "en", "pour", "pas", "sur", "par", "au", "dans", "ou"),
    *("el", "los", "las", "una", "y", "es", "no", "se", "por", "con", "para", "del", "lo", "su", "al", "como"),
)


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie between ``least`` and ``most``; None: no bound."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The production thresholds.
RULES = (
    Rule("n_words", least=50, most=1_000_000),
    Rule("mean_word_length", least=2, most=14),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.7),
    Rule("repeat_word_ratio", most=0.5),
    Rule("upper_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)


def _counts(text: Column) -> dict[str, Column]:
    """First projection: the arrays that several counts share."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE_CHARS)) != "")
    return {"__w": words(text), "__l": lines, "__t": text}


def _windows() -> Column:
    """Hashes of all windows of three words, by place."""
    w = F.col("__w")
    n = F.size(w)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeat_places() -> Column:
    """Windows as (hash, place) in order, only where some window repeats."""
    h = F.col("__h")
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _repeat_starts() -> Column:
    s = F.col("__s")
    same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    starts = F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])
    return F.when(s.isNotNull(), F.sort_array(starts))


def _covered() -> Column:
    """Words in the repeated windows: each adds what the next does not cover."""
    d = F.col("__d")
    add = F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(add, F.lit(0), lambda a, x: a + x), F.lit(0))


def _ratio(part: str, whole: str) -> Column:
    """Part of whole; 0 where there is no whole."""
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Counts and ratios of each text, one row per row of ``df``.

    A null text counts as an empty one; an empty text has 0 everywhere. Ids
    may be null or repeated: rows are never joined or grouped. Other columns of
    ``df`` are not read.
    """
    lower = F.lower("__t")
    lines = F.col("__l")
    listed = F.lit(list(stop_words))
    out = (
        df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
        .select("doc_id", *(c.alias(n) for n, c in _counts(F.col("__t")).items()))
        .withColumn("__h", _windows())
        .withColumn("__s", _repeat_places())
        .withColumn("__d", _repeat_starts())
        .select(
            "doc_id",
            F.size("__w").cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _covered().cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(F.split(lower, r"[^\p{L}]+"), lambda w: F.array_contains(listed, w))).cast("long").alias("n_stop_words"),
            F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace("__t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))).cast("long").alias("n_bullets"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipses"),
        )
    )
    return out.withColumns(
        {
            "mean_word_length": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "word_chars"),
            "stop_word_ratio": _ratio("n_stop_words", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
            "upper_ratio": _ratio("n_upper", "n_letters"),
            "bullet_line_ratio": _ratio("n_bullets", "n_lines"),
            "ellipsis_line_ratio": _ratio("n_ellipses", "n_lines"),
        }
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the metrics that break a rule, as one array expression."""
    broken = []
    for rule in rules:
        x, bad = F.col(rule.metric), F.lit(False)
        if rule.least is not None:
            bad = bad | (x < rule.least)
        if rule.most is not None:
            bad = bad | (x > rule.most)
        broken.append(F.when(bad, F.lit(rule.metric)))
    return F.array_compact(F.array(*broken))


def quality(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """:func:`measure` with ``failed`` (metrics out of bounds), ``base_failed``
    and ``kept``. Empty and null texts have too few words and are not kept.

    One row per row of ``df``, repeated ones and null ids included, and nothing is
    shuffled. Texts of any length are read whole; an empty table gives an empty
    result.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measure(df, id_col, text_col, stop_words).withColumn("failed", compile_rules(rules)).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
