import statistics

import pytest
from pyspark.sql import functions as F

from brindle.functions import timebucket
from brindle.operators import crowd, emotion


def record(ms, person, height=1.0, box=True):
    return (ms, (person, (height, height * 2) if box else None))


@pytest.fixture
def records(spark):
    rows = [record(999, 1), record(1000, 1), record(2000, 1, 3.0), record(2400, 2, 5.0), record(2450, 2, box=False), record(7500, 1), record(12500, 1, 4.0), record(12400, 1, 8.0), record(20000, 3)]
    return spark.createDataFrame(rows, crowd.RECORD)


def test_flatten_filters(records):
    flat = crowd.flatten(records).collect()
    assert sorted(r.timestamp for r in flat) == [1000, 2000, 2400, 7500, 12400, 12500, 20000]
    assert {r.person_id for r in crowd.flatten(records, person_limit=2).collect()} == {1}


def test_buckets_are_centred_and_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (2500, 7500, 12500, 2501, 0)], "ms long").select("ms", timebucket.bucket(F.col("ms"), 5000).alias("b"))
    assert {r.ms: r.b for r in df.collect()} == {2500: 0, 7500: 2, 12500: 2, 2501: 1, 0: 0}


def test_metric(records):
    flat = crowd.with_bucket(crowd.flatten(records), F.col("timestamp"))
    got = {r.interval: r for r in crowd.movement_metric(flat, "person_id", ["box_height", "box_width"]).collect()}
    assert got[0].box_height_mean_sd == pytest.approx(statistics.stdev([1.0, 3.0]))
    assert got[2].box_height_mean_sd == pytest.approx(statistics.stdev([1.0, 4.0, 8.0]))
    assert got[2].box_width_mean_sd == pytest.approx(2 * statistics.stdev([1.0, 4.0, 8.0]))
    assert got[4].box_height_mean_sd is None


def test_normalise(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None), (4, 3.0)], "k int, v double")
    assert {r.k: r.n for r in crowd.normalise(df, "v", "n").collect()} == {1: 0.0, 2: 1.0, 3: None, 4: 0.5}
    constant = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, v double")
    assert {r.n for r in crowd.normalise(constant, "v", "n").collect()} == {None}
    assert crowd.normalise(constant.limit(0), "v", "n").count() == 0


def test_metric_rows(spark):
    df = spark.createDataFrame([(0,), (3,)], "interval long")
    rows = crowd.metric_rows(df, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("interval", timebucket.to_text(F.col("ts")).alias("t"))
    assert {r.interval: r.t for r in rows.collect()} == {0: "2024-01-01 00:00:00", 3: "2024-01-01 00:00:15"}


def running(values):
    out = []
    for i, v in enumerate(values):
        out.append((v + sum(out)) / (i + 1))
    return out


def test_running_average_matches_the_loop(spark):
    series = {1: [3.0, 1.0, 4.0], 2: [5.0, 0.0, 2.5, 7.25, 1.0] * 20}
    rows = [(g, k, v) for g, values in series.items() for k, v in enumerate(values)]
    out = emotion.running_average(spark.createDataFrame(rows, "g int, k int, v double"), "v", ["k"], ["g"]).orderBy("g", "k").collect()
    assert [r.running for r in out if r.g == 1] == pytest.approx([3, 2, 3])
    assert [r.running for r in out if r.g == 2] == pytest.approx(running(series[2]))


def test_change_points(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([0, 0, 3, 3, 4, 3])], "k int, v long")
    assert [(r.k, r.v) for r in emotion.change_points(df, "v", ["k"]).orderBy("k").collect()] == [(2, 3), (4, 4), (5, 3)]


def test_totals_shares_and_decay(spark):
    df = spark.createDataFrame([(1, 50.0, 25.0, None), (2, 25.0, 0.0, 100.0)], "k int, happy double, sad double, calm double")
    scaled = emotion.scale(df)
    sums = emotion.totals(emotion.to_long(scaled))
    assert {r.emotion: (r.total, r.share) for r in emotion.shares(sums).collect()} == {"happy": (0.75, 37.5), "sad": (0.25, 12.5), "calm": (1.0, 50.0)}
    assert scaled.agg(emotion.grand_total(scaled)).first()[0] == 2
    assert emotion.means(scaled).first().calm == 1.0
    decay = emotion.decayed_sum(df.withColumn("g", F.lit(1)), "happy", ["k"], ["g"]).first().weighted
    assert decay == 50 * 1 + 25 * 0.5
    assert emotion.latest(df.withColumn("g", F.lit(1)), ["k"], ["g"]).first().happy == 25.0


def test_sample_times(spark):
    df = spark.createDataFrame([("20240102-030405",), ("soon",)], "t string").select(timebucket.parse_sample_time(F.col("t")).alias("ts"))
    got = df.select(timebucket.to_text(F.col("ts")).alias("t"), timebucket.minute_of_hour(F.col("ts")).alias("m")).collect()
    assert sorted(map(tuple, got), key=str) == [("2024-01-02 03:04:05", 4), (None, None)]
