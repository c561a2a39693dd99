"""Queries through files: what a step writes is what the next one reads.

Each writes whole tables with a sink into the shared folder and reads them back
with the reader of that format; its SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.timebucket import millis
from brindle.operators import crowd, report
from brindle.plans.common import Catalogue
from brindle.session import load, scratch_folder
from brindle.sources import publish, readers, sinks

catalogue = Catalogue()

#: Python's and Spark's white space at the ends of a line, for DuckDB.
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@catalogue.add("SELECT 'feeds_' || lang AS topic, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS position, source AS title, 'http://' || source || '/' || n AS url FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)")
def feed_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed lists, one file a topic, published and read: topic and place come from the file.
    A list is a topic's sources, which do not grow with its documents."""
    path = scratch_folder(spark, "feeds")
    feeds = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    feed = F.struct(F.col("source").alias("title"), F.concat(F.lit("http://"), "source", F.lit("/"), "n").alias("url"))
    lists = feeds.groupBy("lang").agg(F.to_json(F.struct(F.array_sort(F.collect_list(feed)).alias("feeds"))).alias("content"))
    publish.publish(lists.select(F.col("lang").alias("topic"), F.concat(F.lit("feeds_"), "lang", F.lit(".json")).alias("file"), "content"), path)
    return readers.feed_list(spark, f"{path}/*/*/feeds_*.json")


@catalogue.add(
    """SELECT (row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1) % 50 AS position, source || ' ' || d.doc_id AS title, 'http://x/' || d.doc_id AS link, '2024-01-01' AS publish_date,
 md5(text || '|q' || quality) AS summary, source || ', ' || lang AS tags FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
)
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of labelled articles in files of 50, with whole texts, as a report reads them."""
    path = f"{scratch_folder(spark, 'summaries')}/out"
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    numbered = report.batches(docs.select("source", "doc_id"), ["doc_id"], ["source"])
    article = F.struct(
        F.concat("source", F.lit(" "), "doc_id").alias("title"), F.concat(F.lit("http://x/"), "doc_id").alias("link"), F.lit("2024-01-01").alias("publish_date"),
        F.array(F.col("text"), F.concat(F.lit("q"), "quality")).alias("summary"), F.array("source", "lang").alias("tags"),
    )
    packed = docs.join(numbered.select("doc_id", "batch_id"), "doc_id").groupBy("source", "batch_id")
    files = packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", article.alias("a")))), lambda x: x["a"]).alias("articles"))
    content = F.to_json(F.struct("articles"))
    publish.publish(files.select(F.col("source").alias("topic"), F.concat(F.lit("part-"), "batch_id", F.lit(".json")).alias("file"), content.alias("content")), path)
    read = readers.summaries(spark, f"{path}/*/*/part-*.json")
    return read.select("position", "title", "link", "publish_date", F.md5(F.array_join("summary", "|").cast("binary")).alias("summary"), F.array_join("tags", ", ").alias("tags"))


@catalogue.add(
    """SELECT source AS title, 'http://x/' || d.doc_id AS url, 'Toxic: quality ' || quality AS exception FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1
 UNION ALL SELECT DISTINCT source, NULL, 'pipeline failure' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1"""
)
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed topics and exceptions, gathered into logs by topic and read as the next run does."""
    path = scratch_folder(spark, "logs")
    failed = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    rows = failed.select("source", F.col("source").alias("title"), F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.concat(F.lit("Toxic: quality "), "quality").alias("exception"))
    sinks.grouped_json(rows, ["source"], f"{path}/exceptions", "exceptions")
    sinks.json_lines(failed.groupBy().agg(F.array_sort(F.collect_set("source")).alias("pipeline_failures")), f"{path}/failures")
    failures = readers.failure_log(spark, f"{path}/failures").select(F.col("slug").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("pipeline failure").alias("exception"))
    # A log file has a line for each topic here, so it is read by line.
    logged = spark.read.schema("exceptions array<struct<title: string, url: string, exception: string>>").json(f"{path}/exceptions").select(F.inline("exceptions"))
    return logged.unionByName(failures)


@catalogue.add(f"SELECT md5({_STRIPPED.format('line')}) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE {_STRIPPED.format('line')} <> '' GROUP BY 1")
def markdown_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as one text in ordered parts, read as stripped lines."""
    path = f"{scratch_folder(spark, 'lines')}/out"
    sinks.ordered_text(load(spark, sf_dir, "documents").where("text is not null"), "text", ["doc_id"], path)
    lines = readers.markdown_lines(spark, f"{path}/part-*").where("line <> ''")
    return lines.groupBy(F.md5(F.col("line").cast("binary")).alias("line")).agg(F.count("*").alias("n"))


@catalogue.add("SELECT doc_id, n_chars, lang FROM documents WHERE lang IN ('de', 'en')")
def topic_folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a topic; some topics written again, two of them read."""
    path = f"{scratch_folder(spark, 'topics')}/out"
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    sinks.topics(docs.withColumn("n_chars", F.col("n_chars") + F.when(F.col("lang") == "en", 1).otherwise(0)), path, "lang")
    sinks.topics(docs.where("lang = 'en'"), path, "lang")
    return readers.by_topic(spark, path).where(F.col("lang").isin("de", "en"))


@catalogue.add("SELECT epoch_us(ts) // 1000 AS timestamp, user_id AS person_id, value AS box_height, value / 2 AS box_width FROM events WHERE event_type <> 'error' AND epoch_us(ts) // 1000 >= 1000")
def tracking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tracking records as JSON lines, in two pages, read and flattened."""
    path = scratch_folder(spark, "tracking")
    events = load(spark, sf_dir, "events")
    box = F.when(F.col("event_type") != "error", F.struct(F.col("value").alias("Height"), (F.col("value") / 2).alias("Width")))
    records = events.select(millis(F.col("ts")).alias("Timestamp"), F.struct(F.col("user_id").alias("Index"), box.alias("BoundingBox")).alias("Person"), (F.col("event_type") == "view").alias("later"))
    for later in (False, True):
        sinks.json_lines(records.where(F.col("later") == later).drop("later"), f"{path}/{later}")
    return crowd.flatten(readers.page_union([readers.tracking_records(spark, f"{path}/{later}") for later in (False, True)]))


@catalogue.add("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def row_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended by day-halves, and as CSV with all columns; both read as one table."""
    path = scratch_folder(spark, "rows")
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.hour("ts") < 12).alias("early"))
    for early in (True, False):
        sinks.append_rows(events.where(F.col("early") == early).drop("early"), f"{path}/parquet")
    sinks.csv(events.drop("early"), f"{path}/csv")
    text = spark.read.schema("event_id long, user_id long, value double").csv(f"{path}/csv", header=True)
    both = spark.read.parquet(f"{path}/parquet").join(text.withColumnsRenamed({"user_id": "u", "value": "v"}), "event_id").where("u = user_id and v = value")
    return both.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
