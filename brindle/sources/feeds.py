"""Feeds as a data source: one task a feed, and only the feeds that a query asks for."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from brindle.sources.readers import every_plan_filtered, filters_reach_sources, import_function

ARTICLE = ("title", "summary_from_feed", "content", "content_type", "link", "publish_date")
#: Most feeds of a list: each is a task, and the list is planned on the driver.
MAX_FEEDS = 100_000


class _Feed(InputPartition):
    def __init__(self, feed: dict) -> None:
        super().__init__(feed)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.feeds, self.fetch = json.loads(options["feeds"]), options["fetch"]

    def partitions(self) -> list[InputPartition]:
        return [_Feed(x) for x in self.feeds]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        feed = partition.value
        try:
            found = [(*(a.get(c) for c in ARTICLE), None) for a in import_function(self.fetch)(feed["url"])]
        except Exception as e:  # noqa: BLE001 - a feed that fails is data
            found = [(*[None] * len(ARTICLE), f"{type(e).__name__}: {e}")]
        for row in found:
            yield (feed["position"], feed["topic"], feed["title"], feed["url"], *row)


class FilteredFeedReader(FeedReader):
    """Filters on topic and url choose the feeds; the others are left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("topic",), ("url",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.feeds = [x for x in self.feeds if x[f.attribute[0]] in wanted]
            else:
                yield f


class Feeds(DataSource):
    """Options: ``feeds``, a JSON array of objects with position, topic, title and url; ``fetch``, an
    importable ``module:function`` from a url to article dicts."""

    @classmethod
    def name(cls) -> str:
        return "brindle_feeds"

    def schema(self) -> str:
        return "position int, " + ", ".join(f"{c} string" for c in ("topic", "feed_title", "url", *ARTICLE, "exception"))

    def reader(self, schema) -> DataSourceReader:
        return (FilteredFeedReader if self.options.get("filters") == "true" else FeedReader)(dict(self.options))


def feed_articles(feeds: DataFrame, fetch: str) -> DataFrame:
    """(position, topic, feed_title, url, article columns, exception) of (topic, title, url) rows.

    A feed whose fetch raises is one row with ``exception`` and no article, one
    without articles none. Equal rows of ``feeds`` are one feed. Filters on topic and
    url are pushed to the source, where ``spark.sql.python.filterPushdown.enabled`` is
    set. More than ``MAX_FEEDS`` feeds are an error.
    """
    spark = feeds.sparkSession
    rows = feeds.select("topic", "title", "url").distinct().orderBy("topic", "url", "title").limit(MAX_FEEDS + 1).collect()
    if len(rows) > MAX_FEEDS:
        raise ValueError(f"a feed list has at most {MAX_FEEDS} feeds")
    spark.dataSource.register(Feeds)
    listed = json.dumps([{"position": k} | r.asDict() for k, r in enumerate(rows)])
    found = spark.read.format("brindle_feeds").option("feeds", listed).option("fetch", fetch).option("filters", filters_reach_sources(spark)).load()
    return every_plan_filtered(found, "position")
