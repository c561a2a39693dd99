"""The paged stream and the shown totals, killed and restarted."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQueryException

from brindle.operators import crowd
from brindle.sources.stream import PagedStream, PagedStreamReader
from brindle.streaming import changes, metrics

LOG = Path("/tmp") / "brindle-paged-stream.log"
PAGES = 11
SCHEMA = "page long, k long, ts timestamp, person long, v double"
START = dt.datetime(2024, 1, 1)


def rows_of(page):
    return [(page, k, START + dt.timedelta(milliseconds=137 * (40 * page + k)), k % 4, float((page * 40 + k) * 7919 % 101)) for k in range(40)]


def follow(token):
    """The last page grows while the file "open" is there."""
    page = int(token or 0)
    if page == PAGES - 1:
        return None if LOG.with_suffix(".open").exists() else ""
    return str(page + 1)


def fetch(token):
    page = int(token or 0)
    with LOG.open("a") as log:
        log.write(f"{page}\n")
    return rows_of(page), follow(token)


@pytest.fixture
def paged(spark, tmp_path):
    LOG.unlink(missing_ok=True)
    LOG.with_suffix(".open").unlink(missing_ok=True)
    spark.dataSource.register(PagedStream)
    yield spark.readStream.format("brindle_paged_stream").schema(SCHEMA).option("client", "tests.test_paged_stream:fetch").option("peek", "tests.test_paged_stream:follow").option("pages_per_batch", 3).load()
    LOG.unlink(missing_ok=True)


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_restarted_stream_reads_each_page_once(spark, paged, tmp_path):
    """Killed in its second batch, before the write; then again after all pages but the growing one."""
    out, ck, fails = str(tmp_path / "out"), str(tmp_path / "ck"), [1]

    def write(batch, number):
        if number in fails:
            fails.remove(number)
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    start = lambda: paged.writeStream.foreachBatch(write).option("checkpointLocation", ck).start()
    with pytest.raises(StreamingQueryException):
        drain(start())
    LOG.with_suffix(".open").touch()
    drain(start())
    got = spark.read.parquet(out)
    assert got.count() == 40 * (PAGES - 1) and got.select("page", "k").distinct().count() == got.count()
    assert got.groupBy("batch").agg(F.countDistinct("page").alias("n")).agg(F.max("n")).first()[0] == 3
    LOG.with_suffix(".open").unlink()
    drain(start())
    got = spark.read.parquet(out)
    assert got.count() == 40 * PAGES and got.select("page", "k").distinct().count() == got.count()
    # The killed batch wrote nothing and read nothing; no other page is asked for again.
    assert sorted(map(int, LOG.read_text().split())) == list(range(PAGES))
    drain(start())
    assert len(LOG.read_text().split()) == PAGES


def test_the_crowd_metric_of_polled_pages(spark, paged, tmp_path):
    query = metrics.movement_metric(paged, "ts", "person", "v", 5000, "1 second").writeStream.outputMode("append").format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "ck")).start()
    drain(query)
    got = {r.start: r.metric for r in spark.table("polled").collect()}
    batch = spark.createDataFrame([r for p in range(PAGES) for r in rows_of(p)], SCHEMA)
    ms = crowd.movement_metric(crowd.with_bucket(batch, F.unix_millis("ts") + 0, 5000), "person", ["v"]).collect()
    want = {dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=5000 * r.interval - 2500): r.v_mean_sd for r in ms}
    assert len(got) >= 8 and all(want[k] == pytest.approx(v) for k, v in got.items())


def test_offsets():
    reader = PagedStreamReader({"client": "tests.test_paged_stream:fetch", "peek": "tests.test_paged_stream:follow", "pages_per_batch": "4"})
    first = reader.latestOffset()
    assert first == reader.latestOffset() == {"n": 4, "next": "4", "pages": {"0": None, "1": "1", "2": "2", "3": "3"}}
    assert [p.value for p in reader.partitions(reader.initialOffset(), first)] == [None, "1", "2", "3"]
    # A new process is told where the query stands by an empty range.
    again = PagedStreamReader(reader.options)
    assert again.partitions(first, first) == [] and again.latestOffset()["pages"]["0"] == "4"
    last = {"n": PAGES, "next": "", "pages": {}}
    assert again.partitions(last, last) == [] and again.latestOffset() == last
    with pytest.raises(ValueError):
        again.partitions(reader.initialOffset(), {"n": 9, "next": "9", "pages": {"0": "8"}})
    with pytest.raises(ValueError):
        PagedStreamReader({"pages_per_batch": "0"})


def test_shown_totals_survive_a_restart(spark, tmp_path):
    before = spark.conf.get(changes.STATE_STORE[0])
    spark.conf.set(*changes.STATE_STORE)
    shown = []
    try:
        add = lambda k, rows: spark.createDataFrame(rows, "who string, a double, b double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema("who string, a double, b double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

        def run():
            see = lambda batch, _: shown.extend(tuple(r) for r in batch.collect())
            totals = changes.changed_totals(stream, ["who"], ["a", "b"])
            drain(totals.writeStream.outputMode("update").foreachBatch(see).option("checkpointLocation", str(tmp_path / "ck")).start())

        add(0, [("x", 5.25, None), ("y", None, 0.5), (None, 1.0, 1.0)])
        run()
        assert sorted(shown, key=str) == [("x", 5.25, 0.0, 5), (None, 1.0, 1.0, 2)]
        # After a restart: a fraction changes nothing, a whole number does.
        add(1, [("x", 0.25, 0.25), ("y", 0.0, 0.25)])
        run()
        assert len(shown) == 2
        add(2, [("x", 0.25, None), ("x", 0.0, 0.0), ("y", 0.25, 0.0)])
        run()
        assert sorted(shown[2:]) == [("x", 5.75, 0.25, 6), ("y", 0.25, 0.75, 1)]
        run()
        assert len(shown) == 4
    finally:
        spark.conf.set(changes.STATE_STORE[0], before)
    with pytest.raises(ValueError):
        changes.changed_totals(stream, ["who"], ["total"])
