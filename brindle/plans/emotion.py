"""Emotion queries over ``events``: three kinds of event are three emotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import timebucket
from brindle.operators import emotion
from brindle.plans.common import Catalogue, r6
from brindle.session import load

catalogue = Catalogue()
KINDS = {"happy": "purchase", "sad": "error", "calm": "view"}

_SAMPLES = """SELECT event_id, user_id, ts,
 CASE WHEN event_type = 'purchase' THEN value END / 100.0::DOUBLE AS happy,
 CASE WHEN event_type = 'error' THEN value END / 100.0::DOUBLE AS sad,
 CASE WHEN event_type = 'view' THEN value END / 100.0::DOUBLE AS calm FROM events"""
_TOTALS = f"""WITH f AS ({_SAMPLES}), t AS (
 SELECT 'happy' AS emotion, sum(happy) AS total FROM f UNION ALL SELECT 'sad', sum(sad) FROM f UNION ALL SELECT 'calm', sum(calm) FROM f)"""
_PLACED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = load(spark, sf_dir, "events").withColumns({name: F.when(F.col("event_type") == kind, F.col("value")) for name, kind in KINDS.items()})
    return emotion.scale(wide)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the values needs; its ranges are written, so no other column comes along."""
    return load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotion.totals(emotion.to_long(_samples(spark, sf_dir)))


@catalogue.add(f"{_TOTALS} SELECT emotion, round(total, 6) AS total FROM t")
def emotion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select("emotion", r6("total").alias("total"))


@catalogue.add(f"{_TOTALS} SELECT emotion, round(100.0::DOUBLE * total / sum(total) OVER (), 1) AS share FROM t")
def emotion_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotion.shares(_totals(spark, sf_dir)).select("emotion", "share")


@catalogue.add(f"WITH f AS ({_SAMPLES}) SELECT CAST(floor(sum(coalesce(happy, 0) + coalesce(sad, 0) + coalesce(calm, 0))) AS BIGINT) AS total, round(avg(happy), 6) AS happy, round(avg(sad), 6) AS sad, round(avg(calm), 6) AS calm FROM f")
def emotion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).agg(emotion.grand_total(_samples(spark, sf_dir)).alias("total"), *(r6(F.avg(c)).alias(c) for c in emotion.EMOTIONS))


@catalogue.add(
    f"""WITH RECURSIVE p AS MATERIALIZED ({_PLACED}), r AS (SELECT event_id, user_id, i, value AS running, value AS total FROM p WHERE i = 0 UNION ALL
 SELECT p.event_id, p.user_id, p.i, (p.value + r.total) / (p.i + 1), r.total + (p.value + r.total) / (p.i + 1) FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1)
 SELECT event_id, user_id, round(running, 6) AS running FROM r"""
)
def emotion_running_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = emotion.running_average(_series(spark, sf_dir), "value", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "user_id", r6("running").alias("running"))


@catalogue.add(
    f"""WITH f AS ({_SAMPLES}), d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(floor(sum(coalesce(happy, 0) + coalesce(sad, 0) + coalesce(calm, 0))) AS BIGINT) AS total FROM f GROUP BY 1),
 l AS (SELECT *, lag(total, 1, 0) OVER (ORDER BY day) AS before FROM d) SELECT day, total FROM l WHERE total <> before"""
)
def emotion_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, a short summary, whose whole total differs from the day before."""
    days = _samples(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    totals = days.agg(F.sum(F.coalesce("happy", F.lit(0.0)) + F.coalesce("sad", F.lit(0.0)) + F.coalesce("calm", F.lit(0.0))).cast("bigint").alias("total"))
    return emotion.change_points(totals, "total", ["day"])


@catalogue.add(f"WITH p AS ({_PLACED}) SELECT user_id, round(sum(value * (n - i) / n), 6) AS weighted FROM p GROUP BY user_id")
def emotion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = emotion.decayed_sum(_series(spark, sf_dir), "value", ["ts", "event_id"], ["user_id"])
    return out.select("user_id", r6("weighted").alias("weighted"))


@catalogue.add("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def emotion_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotion.latest(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "value")


@catalogue.add("SELECT event_id, CAST(minute(ts) AS BIGINT) AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value / 100.0::DOUBLE AS value FROM events")
def emotion_sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose time is text of a fixed format, parsed back."""
    text = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", timebucket.SAMPLE_FORMAT).alias("timestamp"), "value")
    at = timebucket.parse_sample_time(F.col("timestamp"))
    return text.select("event_id", timebucket.minute_of_hour(at).alias("minute"), timebucket.to_text(at).alias("at"), (F.col("value") / 100).alias("value"))


@catalogue.add("SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 50")
def emotion_scan_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's scan: its limit of 50 samples is the feature."""
    return emotion.recent_samples(load(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id", "value")
