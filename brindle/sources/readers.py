"""Readers for the engine's inputs. Schemas are explicit: nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.functions.text import strip
from brindle.operators.crowd import RECORD

_FEEDS = "feeds array<struct<title: string, url: string>>"
_ARTICLES = "articles array<struct<title: string, link: string, publish_date: string, summary: array<string>, tags: array<string>>>"
_ITEM = "title string, description string, encoded string, link string, pubDate string"
_TEXT = "struct<_VALUE: string, _type: string>"
_ENTRY = f"title {_TEXT}, summary {_TEXT}, content {_TEXT}, link array<struct<_href: string, _rel: string>>, published string, updated string"


def feed_list(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(topic, position, title, url) of feed-list files with the key ``feeds``.

    ``topic`` is the file's base name; ``position`` the place in the file.
    """
    raw = spark.read.schema(_FEEDS).json(path, multiLine=True).withColumn("topic", F.regexp_replace("_metadata.file_name", r"\.json$", ""))
    return raw.select("topic", F.posexplode("feeds").alias("position", "feed")).select("topic", F.col("position").cast("bigint").alias("position"), "feed.title", "feed.url")


def rss_items(spark: SparkSession, path: str | Sequence[str], row_tag: str = "item") -> DataFrame:
    """Articles of saved RSS files: title, summary, content, link, publish date
    as text and as ``published`` (null if it cannot be parsed)."""
    raw = spark.read.schema(_ITEM).format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").load(path)
    published = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", r"^\s*\w+,\s*", ""), r"\bGMT\b|\bUTC\b", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp("pubDate"),
    )
    return raw.select(
        strip(F.col("title")).alias("title"), strip(F.col("description")).alias("summary_from_feed"), strip(F.col("encoded")).alias("content"),
        strip(F.col("link")).alias("link"), F.col("pubDate").alias("publish_date"), published.alias("published"),
    )


def atom_entries(spark: SparkSession, path: str | Sequence[str], row_tag: str = "entry") -> DataFrame:
    """Articles of saved Atom files, with the columns of :func:`rss_items`.

    The link is the first alternate one (or without a relation), else the first;
    the date is ``published``, or ``updated`` where that is missing.
    """
    raw = spark.read.schema(_ENTRY).format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").load(path)
    plain = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    link = F.coalesce(F.get(plain, F.lit(0)), F.get("link", F.lit(0)))["_href"]
    date = F.coalesce("published", "updated")
    value = lambda c: strip(F.col(c)["_VALUE"])
    return raw.select(
        value("title").alias("title"), value("summary").alias("summary_from_feed"), value("content").alias("content"),
        strip(link).alias("link"), date.alias("publish_date"), F.try_to_timestamp(strip(date)).alias("published"),
    )


def fetch_feeds(feeds: DataFrame, fetch: Callable[[str], list[dict]], parallel: int = 15) -> DataFrame:
    """Articles of each feed: one call of ``fetch`` (url -> article dicts) a feed.

    A call that raises is one row with ``exception`` and no article. ``parallel``
    bounds how many calls run at a time. A column of ``feeds`` that is named like
    one of an article gets the prefix ``feed_``.
    """
    columns = ("title", "summary_from_feed", "content", "content_type", "link", "publish_date")

    feeds = feeds.withColumnsRenamed({c: f"feed_{c}" for c in feeds.columns if c in columns})

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    found = [{c: a.get(c) for c in columns} | {"exception": None} for a in fetch(row["url"])]
                except Exception as e:  # noqa: BLE001 - a feed that fails is data
                    found = [dict.fromkeys(columns) | {"exception": f"{type(e).__name__}: {e}"}]
                out += [row | a for a in found]
            yield pd.DataFrame(out, columns=[*pdf.columns, *columns, "exception"])

    schema = ", ".join(f"`{n}` {t}" for n, t in feeds.dtypes) + "".join(f", {c} string" for c in (*columns, "exception"))
    return feeds.repartition(parallel, "url").mapInPandas(run, schema)


def summaries(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Summarised articles with their ``position``, from files with the key ``articles``."""
    raw = spark.read.schema(_ARTICLES).json(path, multiLine=True)
    return raw.select(F.posexplode("articles").alias("position", "a")).select(F.col("position").cast("bigint").alias("position"), "a.*")


def failure_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(slug) of failed topics; a file that is no JSON gives none."""
    raw = spark.read.schema("pipeline_failures array<string>").json(path, multiLine=True, mode="PERMISSIVE")
    return raw.select(F.explode("pipeline_failures").alias("slug"))


def exception_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    raw = spark.read.schema("exceptions array<struct<title: string, url: string, exception: string>>").json(path, multiLine=True, mode="PERMISSIVE")
    return raw.select(F.inline("exceptions"))


def markdown_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, n, line): the stripped lines of text files, numbered from 0."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select("path", F.posexplode(F.split("value", "\n")).alias("n", "line")).select("path", F.col("n").cast("bigint").alias("n"), strip(F.col("line")).alias("line"))


def by_topic(spark: SparkSession, path: str) -> DataFrame:
    """A folder partitioned by topic: a filter on ``topic`` reads only its folders."""
    return spark.read.parquet(path)


def tracking_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Nested person-tracking records, one JSON object a line."""
    return spark.read.schema(RECORD).json(path)


def page_union(pages: Sequence[DataFrame]) -> DataFrame:
    """All pages after each other, each once; missing columns are null."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out


def import_function(path: str) -> Callable:
    """The function of an importable ``module:function``."""
    import importlib

    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def filters_reach_sources(spark: SparkSession) -> str:
    """Whether the session hands filters to Python sources; a source that takes them
    fails where it does not."""
    return (spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") or "false").lower()


def every_plan_filtered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a filter that holds for every row. Spark keeps the partitions of a
    Python source from plan to plan and makes new ones only for a plan that has
    filters: without this one a frame would give the rows of its last filtered use."""
    return df.where(F.col(column).isNotNull())


class _Page(InputPartition):
    def __init__(self, token: int) -> None:
        super().__init__(token)


class PagedRecords(DataSource):
    """A paged interface as a data source, one task a page.

    Options: ``pages`` (how many) and ``client``, an importable
    ``module:function`` from a page number to rows of the schema.
    """

    @classmethod
    def name(cls) -> str:
        return "brindle_paged"

    def schema(self):
        return self.options.get("schema", RECORD)

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from import_function(self.options["client"])(partition.value)


class TokenPagedRecords(DataSource):
    """An interface whose pages name the next one, as a data source.

    Options: ``client``, an importable ``module:function`` from a token (None for
    the first page) to (rows of the schema, next token; None or "" after the last
    page), and ``most_pages``, beyond which reading is an error. Each page is asked
    for once, after the one that names it, so one task reads the chain and holds a
    page at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "brindle_token_paged"

    def schema(self):
        return self.options.get("schema", RECORD)

    def reader(self, schema) -> DataSourceReader:
        return _TokenPagedReader(dict(self.options))


class _TokenPagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, token = import_function(self.options["client"]), None
        for _ in range(int(self.options.get("most_pages", 1_000_000))):
            rows, token = client(token)
            yield from rows
            if not token:
                return
        raise RuntimeError("more pages than most_pages")
