"""Prefix scans, stored moments and interval joins against plain loops."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from brindle.operators import emotion, fuzzy, intervals, moments, scan
from brindle.plans import emotion as plans


def hot_rows(n=900):
    """One user holds half of all rows, one has no name; ties in the order go by k."""
    rng = random.Random(3)
    return [("hot" if k % 2 else rng.choice(["a", "b", None]), k // 3, k, rng.choice([None, 1.5, 2.0, 2.0, -3.25])) for k in range(n)]


@pytest.fixture
def hot(spark):
    return hot_rows(), spark.createDataFrame(hot_rows(), "u string, t int, k int, v double").repartition(5)


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_a_hot_user_is_spread_over_tasks(spark, hot):
    rows, df = hot
    s = scan.series(df, ["t", "k"], ["u"], 16)
    sizes = [r["count"] for r in s.rows.where("u = 'hot'").groupBy(scan.RANGE).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * sum(sizes)
    got = {(r.u, r.k): r.i for r in scan.numbered(s, "i").collect()}
    assert got == {(u, r[2]): i for u, own in by_user(rows).items() for i, r in enumerate(own)}


def test_running_average_and_decayed_sum(spark, hot):
    rows, df = hot
    got = {r.k: r.running for r in emotion.running_average(df.where("v is not null"), "v", ["t", "k"], ["u"], ranges=11).collect()}
    weighted = {r.u: r.weighted for r in emotion.decayed_sum(df, "v", ["t", "k"], ["u"], ranges=11).collect()}
    for u, own in by_user(rows).items():
        total = 0.0
        for i, r in enumerate(r for r in own if r[3] is not None):
            average = (r[3] + total) / (i + 1)
            total += average
            assert got[r[2]] == pytest.approx(average)
        assert weighted[u] == pytest.approx(sum(r[3] * (len(own) - i) / len(own) for i, r in enumerate(own) if r[3] is not None))
    assert emotion.decayed_sum(df.limit(0), "v", ["t"], ["u"]).count() == 0
    assert emotion.running_average(df.limit(0), "v", ["t"], ["u"]).count() == 0


def test_changes_across_ranges(spark, hot):
    rows, df = hot
    got = sorted(r.k for r in emotion.change_points(df, "v", ["t", "k"], ["u"], ranges=13).collect())
    want = [r[2] for own in by_user(rows).values() for before, r in zip([(0, 0, 0, 0), *own], own, strict=False) if before[3] != r[3]]
    assert got == sorted(want)
    # Without a key, and with ranges that hold no row of a key.
    one = sorted(r.k for r in emotion.change_points(df, "v", ["k"], ranges=7).collect())
    values = [0, *(r[3] for r in rows)]
    assert one == [k for k in range(len(rows)) if values[k] != values[k + 1]]


def test_no_window_over_a_bare_user(spark):
    for query in (plans.emotion_running_avg, plans.emotion_weighted):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if re.search(r"\bWindow\b", line)]
        # Rows are windowed within ranges; only the ranges' sums by user alone.
        assert windows and all("__range" in line for line in windows)


def test_neighbours(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else k * 10) for k in range(50)], "k int, v int").repartition(3)
    got = {r.k: (r.b, r.a) for r in scan.neighbours(scan.series(df, ["k"], (), 9), "v", "b", "a").collect()}
    v = lambda k: None if k % 4 == 0 or not 0 <= k < 50 else k * 10
    assert got == {k: (v(k - 1), v(k + 1)) for k in range(50)}


def test_merged_moments_equal_the_whole(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"2024-01-0{rng.randrange(1, 8)}", rng.choice("ab"), rng.choice([1, 2, None]), rng.choice([None, 1e9 + rng.random(), rng.random()])) for _ in range(400)]
    rows += [("2024-01-01", "c", 1, 5.0), ("2024-01-02", "d", 1, None)]
    df = spark.createDataFrame(rows, "day string, bucket string, person int, v double")
    path, keys = f"{tmp_path}/store", ["bucket", "person"]
    moments.add_days(df.where("day < '2024-01-05'"), path, keys, "v")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    moments.add_days(df.where("day >= '2024-01-05'"), path, keys, "v")
    # A day that comes again replaces itself alone.
    moments.add_days(df.where("day = '2024-01-06'"), path, keys, "v")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    merged = {(r.bucket, r.person): r for r in moments.merge(moments.stored(spark, path), keys).select("*", moments.deviation()).collect()}
    groups = {}
    for _, b, p, v in rows:
        groups.setdefault((b, p), []).extend([] if v is None else [v])
    assert set(merged) == set(groups)
    for k, own in groups.items():
        r = merged[k]
        assert r.n == len(own) and r.mean == (pytest.approx(statistics.mean(own)) if own else None)
        assert r.sd == (pytest.approx(statistics.stdev(own), rel=1e-6) if len(own) > 1 else None)
    metric = {r.bucket: r.metric for r in moments.metric(moments.stored(spark, path), "person", ["bucket"]).collect()}
    for b in "abcd":
        sds = [statistics.stdev(own) for (x, _), own in groups.items() if x == b and len(own) > 1]
        assert metric[b] == (pytest.approx(statistics.mean(sds), rel=1e-6) if sds else None)
    moments.compact(spark, path, f"{tmp_path}/months", keys, F.date_format("day", "yyyy-MM"))
    compacted = {(r.bucket, r.person): r for r in moments.merge(moments.stored(spark, f"{tmp_path}/months"), keys).collect()}
    assert {k: (r.n, r.mean and pytest.approx(r.mean)) for k, r in compacted.items()} == {k: (r.n, r.mean) for k, r in merged.items()}
    assert moments.stored(spark, f"{tmp_path}/months").count() == len(groups)


def sets():
    """Some with descending breakpoints, which warn."""
    return (
        fuzzy.Domain("x").add("z", "Z", -3, 2).add("z0", "Z", 2, 2).add("s", "S", 0, 4).add("s0", "S", 4, 1).add("l", "Lambda", -1, 1, 5).add("bad", "Lambda", 8, 25, 20),
        fuzzy.Domain("y").add("p", "Pi", 0, 1, 2, 3).add("p2", "Pi", 2, 1, 3, 2.5).add("thin", "Lambda", 1, 1 + 2**-40, 1 + 2**-39).add("wide", "Pi", -1e12, -1, 1, 1e12),
    )


def test_degrees_by_interval_join(spark):
    numbers = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.0, 1 + 2**-40, 2.0, 2.5, 3.0, 4.0, 5.0, 8.0, 20.0, 25.0, -3.0, 1e11, -1e300, 1e300, 5e-324]
    rng = random.Random(8)
    numbers += [rng.uniform(-6, 30) for _ in range(150)]
    df = spark.createDataFrame([(k, x, x) for k, x in enumerate(numbers)] + [(1000, 1.0, 1.0)] * 2, "k int, x double, y double")
    with pytest.warns(UserWarning):
        own = sets()
    table = fuzzy.set_table(spark, [*own, fuzzy.Domain("other").add("o", "Z", 0, 1)])
    got = sorted(tuple(r) for r in intervals.fuzzify_table(df, {"x": "x", "y": "y"}, table, ["k"]).collect())
    long = fuzzy.fuzzify_long(df, {d.name: d for d in own}, {"x": "x", "y": "y"}, ["k"])
    want = sorted((r.k, r.domain, r.position, r.set_name, r.degree) for r in long.where("degree > 0").collect())
    assert got == want and len(got) > 300
    assert intervals.fuzzify_table(df.limit(0), {"x": "x"}, table, ["k"]).count() == 0
    assert intervals.fuzzify_table(df, {"x": "x"}, table.limit(0), ["k"]).count() == 0
    same = df.where("k = 1000")
    assert intervals.fuzzify_table(same, {"x": "x"}, table, ["k"]).count() == 2 * sum(r[0] == 6 and r[1] == "x" for r in got)
    with pytest.raises(Exception, match="no pieces"):
        intervals.fuzzify_table(df, {"x": "x"}, table.withColumn("shape", F.lit("own")), ["k"]).collect()


def test_a_million_sets_stay_data(spark):
    values = spark.range(1_000_000).select((F.col("id") / 8).alias("v"))
    sets = intervals.partition_sets(values, "v", "d")
    df = spark.range(2000).select("id", (F.col("id") * 62.3 - 100).alias("x"))
    got = intervals.fuzzify_table(df, {"d": "x"}, sets, ["id"]).groupBy("id").agg(F.sum("degree").alias("s"), F.count("*").alias("n")).collect()
    assert len(got) == 2000 and all(math.isclose(r.s, 1, abs_tol=1e-6) and r.n <= 2 for r in got)
