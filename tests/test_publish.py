"""Publication, feeds as a source, and a text in parts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.sources import feeds, publish, sinks

LOG = Path("/tmp") / "brindle-feeds.log"


def rows(spark, version, topics=("a", "b", "c")):
    return spark.createDataFrame([(t, f"f{k}", f"{version} {t}{k} é") for t in topics for k in range(3)], "topic string, file string, content string").repartition(4)


def test_a_failing_task_leaves_the_old_output(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert publish.published(spark, path).count() == 0
    publish.publish(rows(spark, "old"), path)
    old = sorted(publish.published(spark, path).collect())
    assert len(old) == 9 and old[0].content == "old a0 é"

    def broken(frames):
        for pdf in frames:
            if "b" in set(pdf.topic):
                raise OSError("killed")
            yield pdf

    with pytest.raises(Exception, match="killed"):
        publish.publish(rows(spark, "new").mapInPandas(broken, publish.SCHEMA), path)
    assert sorted(publish.published(spark, path).collect()) == old
    publish.publish(rows(spark, "new", "bd"), path)
    # Nothing of the failed run is left.
    assert sorted(p.name for p in Path(path).iterdir()) == sorted({publish.MANIFEST, *publish.read_manifest(path).values()})
    got = {(r.topic, r.file): r.content.split()[0] for r in publish.published(spark, path).collect()}
    assert got == {(t, f"f{k}"): "old" if t in "ac" else "new" for t in "abcd" for k in range(3)}
    run = publish.read_manifest(path)["a"]
    assert sorted(p.name for p in Path(path, run).iterdir()) == ["a", "c"]
    with pytest.raises(Exception, match="no name"):
        publish.publish(rows(spark, "bad").withColumn("file", F.lit("../x")), path)
    assert len(publish.read_manifest(path)) == 4


def test_a_topic_is_read_alone(spark, tmp_path):
    path = f"{tmp_path}/out"
    publish.publish(rows(spark, "old"), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = publish.published(spark, path).where("topic = 'b'")
        assert one.rdd.getNumPartitions() == 1 and one.count() == 3
        assert publish.published(spark, path).where("topic in ('a', 'x')").count() == 3
        assert publish.published(spark, path).where("topic = 'x'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def fetch(url):
    with LOG.open("a") as log:
        log.write(f"{url}\n")
    if url == "u3":
        raise OSError("down")
    return [] if url == "u4" else [{"title": f"t{k} {url}", "link": f"{url}/{k}"} for k in range(2)]


def test_only_the_feeds_of_a_topic_are_fetched(spark):
    listed = spark.createDataFrame([("x", "A", "u1"), ("x", "B", "u3"), ("y", "C", "u2"), ("y", "D", "u4"), ("x", "A", "u1")], "topic string, title string, url string")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = lambda: sorted(set(LOG.read_text().split())) if LOG.exists() else []
    try:
        LOG.unlink(missing_ok=True)
        articles = feeds.feed_articles(listed, "tests.test_publish:fetch")
        got = articles.where("topic = 'x'").collect()
        assert asked() == ["u1", "u3"]
        assert sorted((r.url, r.link, r.exception) for r in got if r.exception is None) == [("u1", "u1/0", None), ("u1", "u1/1", None)]
        assert [(r.feed_title, r.title, r.exception) for r in got if r.exception] == [("B", None, "OSError: down")]
        LOG.unlink()
        assert articles.where("url in ('u2', 'u4') and title like 't1%'").count() == 1
        assert asked() == ["u2", "u4"]
        LOG.unlink()
        assert articles.count() == 5 and asked() == ["u1", "u2", "u3", "u4"]
        assert articles.where("topic = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        LOG.unlink(missing_ok=True)


def test_a_text_in_parts_is_the_whole_text(spark, tmp_path):
    n = 20_000
    df = spark.range(n).select((n - F.col("id")).alias("k"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("## é "), (n - F.col("id")).cast("string"), F.lit("\n* x"))).alias("section"))
    index = sinks.ordered_text(df, "section", ["k"], f"{tmp_path}/report", 6).orderBy("part").collect()
    want = "".join(f"{r.section or ''}\n" for r in df.orderBy("k").collect()).encode()
    got = [Path(tmp_path, "report", r.file).read_bytes() for r in index]
    assert len(index) == 6 and b"".join(got) == want
    assert [(r.offset, r.bytes) for r in index] == [(sum(map(len, got[:k])), len(got[k])) for k in range(6)]
    r = index[3]
    assert want[r.offset : r.offset + r.bytes] == got[3]
    assert sum(json.loads(line)["bytes"] for p in Path(tmp_path, "report/_index").glob("part-*") for line in p.read_text().splitlines()) == len(want)
    assert spark.read.text(f"{tmp_path}/report", lineSep="\n").count() == want.count(b"\n")
    empty = sinks.ordered_text(df.limit(0), "section", ["k"], f"{tmp_path}/none")
    assert sum(r.bytes for r in empty.collect()) == 0
