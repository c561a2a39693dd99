import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import crowd
from brindle.streaming import metrics


@pytest.fixture
def folder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(milliseconds=137 * k), k % 4, float((k * 7919) % 101)) for k in range(600)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "ts timestamp_ntz, person int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def test_closed_windows_equal_the_batch(spark, folder):
    schema = "ts timestamp_ntz, person int, v double"
    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
    out = metrics.movement_metric(stream, "ts", "person", "v", 5000, "1 second")
    query = out.writeStream.outputMode("append").format("memory").queryName("movement").option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.start: r.metric for r in spark.table("movement").collect()}
    batch = metrics.as_event_time(spark.read.parquet(str(folder / "in")), "ts")
    bucketed = crowd.with_bucket(batch, F.unix_millis("ts") + 0, 5000)
    ms = {r.interval: r.v_mean_sd for r in crowd.movement_metric(bucketed, "person", ["v"]).collect()}
    epoch = dt.datetime(1970, 1, 1)
    want = {epoch + dt.timedelta(milliseconds=5000 * k - 2500): v for k, v in ms.items()}
    assert len(got) >= 10
    assert all(want[k] == pytest.approx(v) for k, v in got.items())


def test_totals_are_shown_on_change_only(spark, tmp_path):
    shown = []
    for k, v in enumerate((5.2, 0.3, 4.0)):
        spark.createDataFrame([(v, 0.0)], "a double, b double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("a double, b double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = metrics.on_change(metrics.emotion_totals(stream, ["a", "b"]), shown.append, str(tmp_path / "ck"), {"availableNow": True})
    query.awaitTermination(120)
    totals = [r["total"] for r in shown]
    assert totals[-1] == 9 and all(a != b for a, b in zip(totals, totals[1:]))


def test_recent_drops_old_rows(spark, folder):
    stream = spark.readStream.schema("ts timestamp_ntz, person int, v double").parquet(str(folder / "in"))
    out = metrics.recent(stream, "ts", F.lit("2024-01-02 00:01:00").cast("timestamp"), 24)
    query = out.writeStream.format("memory").queryName("recent").option("checkpointLocation", str(folder / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert 0 < spark.table("recent").count() < 600
