"""Crowd-movement queries over ``events``: users are persons, a day is a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import timebucket
from brindle.operators import crowd, moments
from brindle.plans.common import Catalogue, r6
from brindle.session import load, scratch_folder

catalogue = Catalogue()
DAY_MS = 86_400_000

_BUCKETED = "SELECT *, CAST(round_even(epoch_ms(ts) / 86400000.0::DOUBLE, 0) AS BIGINT) AS bucket FROM events"
_METRIC = f"""WITH b AS ({_BUCKETED}),
 s AS (SELECT user_id, bucket, stddev_samp(value) AS sd FROM b GROUP BY ALL),
 m AS (SELECT bucket, avg(sd) AS metric FROM s GROUP BY bucket)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.with_bucket(load(spark, sf_dir, "events"), timebucket.millis(F.col("ts")), DAY_MS, "bucket")


def _metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crowd.movement_metric(_events(spark, sf_dir), "user_id", ["value"], ["bucket"])
    return out.withColumnRenamed("value_mean_sd", "metric")


@catalogue.add(f"SELECT bucket, count(*) AS n FROM ({_BUCKETED}) WHERE epoch_ms(ts) >= 1000 GROUP BY bucket")
def crowd_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(timebucket.millis(F.col("ts")) >= crowd.SKIP_MS).groupBy("bucket").agg(F.count("*").alias("n"))


@catalogue.add("SELECT CAST(round_even(l_quantity / 4.0::DOUBLE, 0) AS BIGINT) AS bucket, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def bucket_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.with_bucket(load(spark, sf_dir, "lineitem"), F.col("l_quantity"), 4, "bucket").groupBy("bucket").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


@catalogue.add(f"SELECT user_id, bucket, count(*) AS n_samples, round(stddev_samp(value), 6) AS sd FROM ({_BUCKETED}) GROUP BY user_id, bucket")
def crowd_person_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crowd.person_deviation(_events(spark, sf_dir), "user_id", ["value"], ["bucket"])
    return out.select("user_id", "bucket", "n_samples", r6("value_sd").alias("sd"))


@catalogue.add(f"{_METRIC} SELECT bucket, round(metric, 6) AS metric FROM m")
def crowd_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir).select("bucket", r6("metric").alias("metric"))


@catalogue.add(
    f"""{_METRIC} SELECT bucket, round(metric, 6) AS metric,
 round((metric - min(metric) OVER ()) / nullif(max(metric) OVER () - min(metric) OVER (), 0), 6) AS metric_norm FROM m"""
)
def crowd_metric_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crowd.normalise(_metric(spark, sf_dir), "metric", "metric_norm")
    return out.select("bucket", r6("metric").alias("metric"), r6("metric_norm").alias("metric_norm"))


@catalogue.add(
    f"""{_METRIC} SELECT round(metric, 6) AS height_mean_sd, bucket,
 strftime(TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds((bucket - 19723) * 86400000), '%Y-%m-%d %H:%M:%S') AS ts FROM m"""
)
def crowd_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a relational table: the metric with the time of its bucket."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = crowd.metric_rows(_metric(spark, sf_dir).withColumn("day", F.col("bucket") - 19723), base, "day", DAY_MS)
    return rows.select(r6("metric").alias("height_mean_sd"), "bucket", timebucket.to_text(F.col("ts")).alias("ts"))


@catalogue.add(
    f"""WITH b AS ({_BUCKETED}), s AS (SELECT event_type, user_id, bucket, stddev_samp(value) AS sd FROM b GROUP BY ALL)
 SELECT event_type, bucket, round(avg(sd), 6) AS metric FROM s GROUP BY event_type, bucket"""
)
def crowd_type_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crowd.movement_metric(_events(spark, sf_dir), "user_id", ["value"], ["event_type", "bucket"])
    return out.select("event_type", "bucket", r6("value_mean_sd").alias("metric"))


@catalogue.add("SELECT epoch_us(ts) // 1000 AS timestamp, user_id AS person_id, value AS box_height, value / 2 AS box_width FROM events WHERE event_type <> 'error' AND epoch_us(ts) // 1000 >= 1000")
def person_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tracking records, of which one kind of event has no box."""
    box = F.when(F.col("event_type") != "error", F.struct(F.col("value").alias("Height"), (F.col("value") / 2).alias("Width")))
    records = load(spark, sf_dir, "events").select(timebucket.millis(F.col("ts")).alias("Timestamp"), F.struct(F.col("user_id").alias("Index"), box.alias("BoundingBox")).alias("Person"))
    return crowd.flatten(records)


@catalogue.add(
    """WITH s AS (SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, stddev_samp(value) AS sd FROM events GROUP BY ALL)
 SELECT week, round(avg(sd), 6) AS metric FROM s GROUP BY week"""
)
def crowd_metric_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly metric from moments that are stored day by day: the last day comes
    to a store of all others, which are not read again."""
    days = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last, path = days.agg(F.max("day")).scalar(), scratch_folder(spark, "moments")
    for part in (days.where(F.col("day") < last), days.where(F.col("day") == last)):
        moments.add_days(part, path, ["user_id"], "value")
    week = F.date_format(F.date_trunc("week", F.col("day").cast("timestamp")), "yyyy-MM-dd")
    return moments.metric(moments.stored(spark, path).withColumn("week", week), "user_id", ["week"]).select("week", r6("metric").alias("metric"))
