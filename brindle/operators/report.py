"""News reports: feeds, recency, scoped dedup, batches, model calls, Markdown."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.functions.timebucket import cutoff, to_text
from brindle.session import cut

BATCH_SIZE = 50
#: Most rows of one model call.
MOST_ROWS = 1000
ATTEMPTS = 5
RECENT_HOURS = 24

#: Fixed value: what stands before a report's title.
HEADING = "# Daily Article Summaries:  *"

SUMMARY = "title string, link string, publish_date string, summary array<string>, tags array<string>"


def dedup_keep_first(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Distinct rows of ``columns`` with the least ``order`` of each."""
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def enumerate_rows(df: DataFrame, order: Sequence[str], name: str = "index", by: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 0 by ``order`` within ``by``. Without ``by`` all rows pass
    through one task: for feed lists and the like."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def dedup_within(df: DataFrame, scope: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per ``scope`` and ``columns``: an article in two feeds stays in both."""
    return df.dropDuplicates([*scope, *columns])


def recent(df: DataFrame, ts: str, as_of: Column, hours: int = RECENT_HOURS) -> DataFrame:
    """Rows from exactly ``hours`` before ``as_of`` on; unparsed (null) times are dropped."""
    return df.where(F.col(ts).isNotNull() & (F.col(ts) >= cutoff(as_of, hours)))


def complete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows in which no required column is null."""
    return df.dropna(subset=list(required))


def html_only_when(content: Column, content_type: Column, converted: Column) -> Column:
    """The converted content where the type is text/html, else the content."""
    return F.when(text.strip(content_type) == "text/html", converted).otherwise(content)


def failures(df: DataFrame, keep: Sequence[str] = ("title", "url")) -> DataFrame:
    return df.where(F.col("exception").isNotNull()).select(*keep, "exception")


def without_failed(topics: DataFrame, failed: DataFrame, key: str = "slug") -> DataFrame:
    return topics.join(failed.select(key).distinct(), key, "left_anti")


def debug_group(topics: DataFrame, group: DataFrame, key: str = "slug") -> DataFrame:
    return topics.join(group.select(key).distinct(), key, "left_semi")


def has_rows(df: DataFrame, by: Sequence[str], is_row: Column) -> DataFrame:
    """By group, whether any row counts."""
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(is_row), F.lit(False)).alias("has_rows"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


def batches(df: DataFrame, order: Sequence[str], by: Sequence[str], size: int = BATCH_SIZE, name: str = "batch_id") -> DataFrame:
    """Rows numbered into batches of ``size`` by ``order`` within ``by``.

    In two steps: ranges of rows in order, then rows of one range, so a group of any
    size is spread over tasks. The ranges are cut through the shared folder: pass
    the columns that number the rows, and join long ones afterwards.
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"__by_{k}" for k in range(len(by))]
    bases = counts.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    numbered = ranged.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1)
    same = F.col("__part") == F.col("__at")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return numbered.join(bases, same).select(*df.columns, F.floor((F.col("__base") + F.col("__k")) / F.lit(size)).cast("bigint").alias(name))


def _calls(model: Callable[[list[dict]], str], keys: Sequence[str], attempts: int, pause_s: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of (``keys``, rows as JSON) -> an answer for each row. An Arrow batch holds
    the texts of many calls: one call's are Python objects at a time, and its answer leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                rows, answer, error = own.column(len(keys))[0].as_py(), None, None
                for attempt in range(1, attempts + 1):
                    try:
                        candidate = model(json.loads(rows))
                        json.loads(_repair(candidate))
                        answer, error = candidate, None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a model is tried again and reported
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause_s)
                made = [pa.array([answer], pa.string()), pa.array([attempt], pa.int64()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], *made], [*keys, "answer", "attempts", "exception"])
            pa.default_memory_pool().release_unused()

    return run


def call_model(
    df: DataFrame,
    model: Callable[[list[dict]], str],
    inputs: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    attempts: int = ATTEMPTS,
    pause_s: float = 0.0,
    most: int = MOST_ROWS,
) -> DataFrame:
    """One call of ``model`` per batch: (``keys``, answer, attempts, exception).

    ``model`` gets the batch's rows as dicts and returns text that must parse as
    JSON once repaired; anything else is tried again, ``attempts`` times in all.
    A batch that still fails is a row with an exception, not a failed job. Write
    the result before using it: a call costs and may not give the same twice.
    A batch's rows come together in one task, so one of more than ``most`` rows is
    an error: number them with :func:`batches` and join what the calls return.
    """
    n = F.count("*")
    rows = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*inputs).alias("r")))), lambda x: x["r"]))
    packed = df.groupBy(*keys).agg(F.when(n <= most, rows).otherwise(F.raise_error(F.concat(F.lit("a batch has "), n.cast("string"), F.lit(f" rows, more than {most}")))).alias("__rows"))

    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", answer string, attempts bigint, exception string"
    return packed.mapInArrow(_calls(model, list(keys), attempts, pause_s), schema)


def _repair(answer: str) -> str:
    """:func:`brindle.functions.text.repair_json` for one text."""
    out = answer.strip().removeprefix("```").lstrip().removeprefix("json")
    last = out.rfind("}")
    if "```" in out[last + 1 :]:
        out = out[: last + 1]
    return out.strip()


def parse_summaries(answers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per article of each answer, with its place in the answer and
    ``is_valid``: three summary lines, 5 to 20 tags."""
    parsed = answers.where(F.col("answer").isNotNull()).select(*keep, F.from_json(text.repair_json(F.col("answer")), f"articles array<struct<{SUMMARY.replace(' ', ':').replace(',:', ',')}>>").alias("__p"))
    rows = parsed.select(*keep, F.posexplode("__p.articles").alias("position", "__a")).select(*keep, F.col("position").cast("bigint").alias("position"), "__a.*")
    return rows.withColumn("is_valid", (F.size("summary") == 3) & F.size("tags").between(5, 20))


def check_echo(summaries: DataFrame, articles: DataFrame, keys: Sequence[str] = ("batch_id", "link")) -> DataFrame:
    """``summaries`` with ``is_known``: whether the echoed keys are in the batch."""
    known = articles.select(*keys).distinct().withColumn("__known", F.lit(True))
    return summaries.join(known, list(keys), "left").withColumn("is_known", F.coalesce("__known", F.lit(False))).drop("__known")


def sorted_tags(tags: Column) -> Column:
    """Tags escaped, in order and joined. Those that hold nothing to escape or strip, as
    one look at all of them tells, are left as they are."""
    special = "".join("\\" + c for c in text.MARKDOWN_SPECIAL)
    odd = F.array_join(tags, "").rlike(rf"(?U)[{special}$\s]")
    shaped = F.when(odd, F.transform(tags, lambda t: text.strip(text.escape_markdown(t)))).otherwise(tags)
    return F.array_join(F.array_sort(shaped), ", ")


def shown(value: Column) -> Column:
    """Text as it stands in a report."""
    return text.strip(text.escape_markdown(value))


def section_text(title: Column, link: Column, lines: Column, tags: Column, publish_date: Column) -> Column:
    """The Markdown of one article whose texts are :func:`shown` and tags joined."""
    bullets = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("* "), s)), "\n")
    return F.concat(
        F.lit("## ["), title, F.lit("]("), link, F.lit(")\n"), bullets,
        F.lit("\n\n**Tags:** "), tags, F.lit("\n\n**Publish Date:** "), publish_date, F.lit("\n"),
    )


def article_section(title: Column, link: Column, summary: Column, tags: Column, publish_date: Column) -> Column:
    """The Markdown of one article."""
    return section_text(shown(title), link, F.transform(summary, shown), sorted_tags(tags), publish_date)


def ordered_join(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, separator: str = "\n") -> DataFrame:
    """The texts of each group joined in order: one report a group."""
    parts = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["v"]), separator).alias(name))


def article_report(sections: DataFrame, by: Sequence[str], order: Sequence[str], title: Column | None = None, updated: Column | None = None, heading: str = HEADING) -> DataFrame:
    """One Markdown report a group, with an optional title and update line.

    A group's sections come together in one row; :func:`report_parts` bounds them.
    """
    body = ordered_join(sections, by, order, "section", "__body")
    head = [F.when(title.isNotNull(), F.concat(F.lit(heading), title, F.lit("*\n")))] if title is not None else []
    if updated is not None:
        head += [F.concat(F.lit("**Updated:** "), to_text(updated), F.lit("\n")), F.lit("*Summaries and tags are written by a language model from the articles below:*\n")]
    return body.select(*by, F.concat_ws("\n", *head, F.col("__body")).alias("report"))


def report_parts(
    sections: DataFrame, by: Sequence[str], order: Sequence[str], size: int = BATCH_SIZE, name: str = "part", build: Callable[[Column], Column] = lambda row: row["section"]
) -> DataFrame:
    """(``by``, ``name``, report, n): a group's report in parts of ``size`` sections.

    The parts of a group, one after another with a line break between, are its report.
    ``order`` must tell the rows of a group apart. ``build`` makes a section of a
    row, after the shuffle, so what a section repeats is moved once.
    """
    keys = [*by, *order]
    numbered = batches(sections.select(*keys), order, by, size, name)
    joined = sections.join(numbered.select(*(F.col(k).alias(f"__{k}") for k in keys), name), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)))
    parts = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*sections.columns).alias("v"))))
    return joined.groupBy(*by, name).agg(F.array_join(F.transform(parts, lambda p: build(p["v"])), "\n").alias("report"), F.count("*").alias("n"))


def strategy_lines(df: DataFrame, line: str) -> DataFrame:
    """List lines reworked: blank ones dropped, ``a; b`` as two sentences."""
    return df.where(text.strip(F.col(line)) != "").withColumn(line, text.split_semicolon(text.bullet(F.col(line))))


def strategy_report(topics: DataFrame, lines: DataFrame, heading: str, preamble: Sequence[str], updated: Column, level: str = "#") -> DataFrame:
    """One report over topics (slug, title, position) and lines (slug, n, line).

    A topic without lines is left out. There are few topics: one row results.
    """
    per_topic = ordered_join(strategy_lines(lines, "line"), ["slug"], ["n"], "line", "body", "\n\n").join(topics, "slug")
    source = F.concat(F.lit("[Source Material]("), F.replace("slug", F.lit("feeds_"), F.lit("")), F.lit("_summaries.html)\n"))
    section = F.concat(F.lit(f"{level}## "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n\n"), source)
    joined = ordered_join(per_topic.withColumn("section", section).withColumn("all", F.lit(1)), ["all"], ["position"], "section", "body")
    head = F.concat(F.lit(f"{level} {heading}\n\n" + "".join(p + "\n\n" for p in preamble) + "**Updated:** "), to_text(updated), F.lit(f"\n\n{level}# Topics\n\n"))
    return joined.select(text.strip(F.concat(head, F.col("body"))).alias("report"))
