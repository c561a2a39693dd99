import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import html, prompts, text
from brindle.operators import report
from brindle.plans import report as plans
from brindle.sources import readers, sinks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("line", "want"),
    [("- a", "* a"), ("- a; b", "* a. B"), ("- a; b; c", "* a; b; c"), ("  - one;two words  ", "* one. Two words"), ("- a;", "* a. ")],
)
def test_strategy_lines(spark, line, want):
    df = spark.createDataFrame([(line,), ("   ",), ("",)], "line string")
    assert [r.line for r in report.strategy_lines(df, "line").collect()] == [want]


@pytest.mark.parametrize("answer", ['{"k": {"a": 1}}', '```\n{"k": {"a": 1}}\n```', '```json\n{"k": {"a": 1}}\n```', '{"k": {"a": 1}}```', '  \n```json {"k": {"a": 1}}\n``` bye', ' json {"k": {"a": 1}} '])
def test_json_repair(spark, answer):
    assert json.loads(one(spark, answer, text.repair_json)) == {"k": {"a": 1}}
    assert json.loads(report._repair(answer)) == {"k": {"a": 1}}


def test_text_functions(spark):
    assert one(spark, "\u2003 a b \n", text.strip) == "a b"
    assert one(spark, "a   b  c", text.collapse_spaces) == "a b c"
    assert one(spark, "éa b", text.capitalise_first) == "Éa b"
    assert one(spark, "a/b/c.json", text.basename) == "c.json"
    assert one(spark, "a*b $1", text.escape_markdown) == "a\\*b \\$1"
    assert one(spark, "\\$1", text.unescape_dollars) == "$1"


def test_recency_bounds(spark):
    as_of = dt.datetime(2024, 1, 2, 12)
    rows = [(1, as_of - dt.timedelta(hours=24)), (2, as_of - dt.timedelta(hours=24, seconds=1)), (3, None), (4, as_of)]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    assert sorted(r.k for r in report.recent(df, "ts", F.lit(as_of)).collect()) == [1, 4]


def test_dedup_scope(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "feed int, t string")
    assert report.dedup_within(df, ["feed"], ["t"]).count() == 3


def model(fail_first):
    calls = {"n": 0}

    def run(rows):
        calls["n"] += 1
        if calls["n"] <= fail_first:
            return "no json"
        return "```json\n" + json.dumps({"articles": [{"title": r["t"], "link": r["t"], "publish_date": "d", "summary": ["1", "2", "3"], "tags": list("abcde")} for r in rows]}) + "\n```"

    return run


@pytest.mark.parametrize(("fail_first", "attempts"), [(0, 1), (4, 5), (5, 5)])
def test_model_calls(spark, fail_first, attempts):
    df = spark.createDataFrame([(0, k, f"t{k}") for k in range(3)], "batch_id long, k int, t string").coalesce(1)
    out = report.call_model(df, model(fail_first), ["t"], ["batch_id"], ["k"]).collect()
    assert [r.attempts for r in out] == [attempts]
    assert (out[0].exception is None) == (fail_first < 5) and (out[0].answer is None) == (fail_first >= 5)
    if fail_first < 5:
        rows = report.parse_summaries(spark.createDataFrame(out, "batch_id long, answer string, attempts long, exception string"), ["batch_id"])
        assert [(r.position, r.title, r.is_valid) for r in rows.orderBy("position").collect()] == [(k, f"t{k}", True) for k in range(3)]
        known = df.select("batch_id", F.col("t").alias("link")).where("link <> 't1'")
        assert {r.link: r.is_known for r in report.check_echo(rows, known).collect()} == {"t0": True, "t1": False, "t2": True}


def test_prompts_carry_the_rows():
    seen = []
    ask = prompts.model_from(lambda p: seen.append(p) or "{}")
    assert ask([{"title": "é"}]) == "{}"
    assert seen[0].startswith(prompts.SUMMARISE) and json.loads(seen[0][len(prompts.SUMMARISE) :]) == [{"title": "é"}]


def test_reports(spark):
    sections = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "topic string, n int, section string")
    stamp = F.lit("2024-01-02 03:04:05.678").cast("timestamp")
    got = report.article_report(sections, ["topic"], ["n"], F.lit("T"), stamp).first().report
    assert got == "# Daily Article Summaries:  *T*\n\n**Updated:** 2024-01-02 03:04:05\n\n*Summaries and tags are written by a language model from the articles below:*\n\none\ntwo"
    topics = spark.createDataFrame([("feeds_b", "B", 0), ("feeds_a", "A", 1), ("feeds_none", "N", 2)], "slug string, title string, position int")
    lines = spark.createDataFrame([("feeds_a", 0, "- x; y"), ("feeds_b", 0, ""), ("feeds_b", 1, "- z")], "slug string, n int, line string")
    got = report.strategy_report(topics, lines, "Review", ["How to read."], stamp).first().report
    assert got.startswith("# Review\n\nHow to read.\n\n**Updated:** 2024-01-02 03:04:05\n\n## Topics\n\n### B\n\n* z\n\n[Source Material](b_summaries.html)")
    assert got.endswith("### A\n\n* x. Y\n\n[Source Material](a_summaries.html)") and "### N" not in got


def test_html_assembly(spark):
    assert one(spark, "<h2>Two</h2><h1>One  <b>x</b></h1>", html.first_header) == "One  x"
    assert one(spark, "<h2>Two</h2>", html.title_tag) == "<title>Two</title>"
    assert one(spark, "<p>none</p>", html.title_tag) == ""
    got = one(spark, "<h2>b</h2><h1>a</h1>", html.assemble)
    assert got == '<!DOCTYPE html>\n<head>\n\t<title>a</title>\n\t<meta name="ai-content" content="none">\n</head>\n<body>\n<h2>b</h2><h1>a</h1>\n</body>'
    headed = "<!DOCTYPE html><head></head><body>x</body>"
    assert one(spark, headed, html.assemble) == headed
    assert "<title>given</title>" in one(spark, "<title>own</title>", lambda c: html.assemble(c, title=F.lit("given")))


def test_markdown_both_ways():
    page = '<h1>T</h1><p>a <b>b</b> <a href="u">l</a> &amp;</p><ul><li>x</li><li>y</li></ul><script>z</script>'
    assert html.to_markdown_text(page) == "# T\n\na **b** [l](u) &\n\n* x\n* y"
    assert html.to_html_text("# T\n\na **b** *c* [l](u) \\$1\n\n* x\n* y") == '<h1>T</h1>\n<p>a <strong>b</strong> <em>c</em> <a href="u">l</a> $1</p>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>'
    assert html.to_markdown_text(None) is None and html.to_html_text(None) is None


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "feeds_x.json").write_text(json.dumps({"feeds": [{"title": "a", "url": "u1"}, {"title": "b", "url": "u2"}]}, indent=1))
    feeds = readers.feed_list(spark, str(tmp_path / "feeds_x.json"))
    assert [tuple(r) for r in feeds.orderBy("position").collect()] == [("feeds_x", 0, "a", "u1"), ("feeds_x", 1, "b", "u2")]

    def fetch(url):
        if url == "u2":
            raise OSError("down")
        return [{"title": "t", "link": "l"}]

    got = {r.url: r for r in readers.fetch_feeds(feeds, fetch, 2).collect()}
    assert got["u1"].link == "l" and got["u1"].exception is None and got["u2"].exception == "OSError: down"
    (tmp_path / "r.xml").write_text("<rss><channel><item><title> A </title><link>l</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>B</title><pubDate>soon</pubDate></item></channel></rss>")
    items = {r.title: r for r in readers.rss_items(spark, str(tmp_path / "r.xml")).collect()}
    assert items["A"].published == dt.datetime(2024, 1, 2, 3, 4, 5) and items["B"].published is None
    (tmp_path / "s.md").write_text("- a\n\n  - b \n")
    assert [(r.n, r.line) for r in readers.markdown_lines(spark, str(tmp_path / "s.md")).orderBy("n").collect()] == [(0, "- a"), (1, ""), (2, "- b"), (3, "")]
    (tmp_path / "f.json").write_text('{"pipeline_failures": ["feeds_x"]}')
    assert [r.slug for r in readers.failure_log(spark, str(tmp_path / "f.json")).collect()] == ["feeds_x"]
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.failure_log(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "e.json").write_text('{"exceptions": [{"title": "a", "url": "u", "exception": "x"}]}')
    assert readers.exception_log(spark, str(tmp_path / "e.json")).first().exception == "x"
    (tmp_path / "a.json").write_text(json.dumps({"articles": [{"title": "t", "link": "l", "publish_date": "d", "summary": ["s"], "tags": ["g"]}]}))
    assert readers.summaries(spark, str(tmp_path / "a.json")).first().tags == ["g"]
    (tmp_path / "p.json").write_text('{"Timestamp": 5, "Person": {"Index": 1, "BoundingBox": {"Height": 1.0, "Width": 2.0}}}\n{"Timestamp": 6, "Person": {"Index": 1}}\n')
    assert readers.tracking_records(spark, str(tmp_path / "p.json")).count() == 2
    assert readers.page_union([feeds, feeds.drop("title")]).count() == 4

    assert sinks.parquet_if_any(feeds, str(tmp_path / "out")) and not sinks.parquet_if_any(feeds.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for _ in range(2):
        sinks.topics(feeds, str(tmp_path / "topics"))
    assert readers.by_topic(spark, str(tmp_path / "topics")).where("topic = 'feeds_x'").count() == 2
    sinks.csv(feeds, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == feeds.columns
    sinks.grouped_json(feeds, ["topic"], str(tmp_path / "grouped"))
    assert len(spark.read.json(str(tmp_path / "grouped")).first().rows) == 2
    sinks.json_lines(feeds, str(tmp_path / "lines"))
    sinks.append_rows(feeds, str(tmp_path / "rows"))
    sinks.append_rows(feeds, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4
    sinks.text_report(feeds.select("title").limit(1), "title", str(tmp_path / "text"))
    sinks.pages(feeds.select("topic", "title").limit(1), "topic", "title", str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "file=x_summaries.html").exists()


def page(k):
    return [(1000 * k, (k, (1.0, 2.0)))]


def test_paged_source_reads_each_page_once(spark):
    spark.dataSource.register(readers.PagedRecords)
    df = spark.read.format("brindle_paged").option("pages", "3").option("client", "tests.test_report:page").load()
    assert sorted(r.Timestamp for r in df.collect()) == [0, 1000, 2000]


def test_tags_and_sections_hold_the_whole_text(spark, tmp_path):
    text = "aa " * 100 + "late*word"
    spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s"), (3, "b", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tags = {r.doc_id: (r.tags, r.n) for r in plans.tags_sorted_whole(spark, str(tmp_path)).collect()}
    assert tags[1] == ("aa, late, word", 3) and tags[3] == ("b", 1)
    shown = text.replace("*", "\\*")
    section = f"## [{shown}](http://x/1)\n* {shown}\n* q1\n\n**Tags:** s, z\n\n**Publish Date:** 2024-01-01\n"
    assert [tuple(r) for r in plans.article_sections(spark, str(tmp_path)).collect()] == [("s", 1, hashlib.md5(section.encode()).hexdigest())]


TOKEN_PAGES = {None: ([(0, (0, (1.0, 2.0)))], "b"), "b": ([], "c"), "c": ([(2, (1, (1.0, 2.0))), (3, (2, None))], "")}


def token_page(token):
    return TOKEN_PAGES[token]


def test_chained_pages_are_read_once_each(spark):
    spark.dataSource.register(readers.TokenPagedRecords)
    df = spark.read.format("brindle_token_paged").option("client", "tests.test_report:token_page")
    assert sorted(r.Timestamp for r in df.load().collect()) == [0, 2, 3]
    with pytest.raises(Exception, match="most_pages"):
        df.option("most_pages", "2").load().collect()


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>'
        '<entry><title type="text"> A </title><link rel="self" href="s"/><link rel="alternate" href="l"/><published>2024-01-02T03:04:05Z</published><updated>2024-01-03T00:00:00Z</updated><summary>S</summary><content type="html">&lt;p&gt;C&lt;/p&gt;</content></entry>'
        '<entry><title>B</title><link href="m"/><updated>2024-01-03T00:00:00+01:00</updated></entry><entry><title>C</title><updated>soon</updated></entry></feed>'
    )
    got = {r.title: r for r in readers.atom_entries(spark, str(tmp_path / "a.xml")).collect()}
    assert (got["A"].link, got["A"].summary_from_feed, got["A"].content, got["A"].published) == ("l", "S", "<p>C</p>", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert (got["B"].link, got["B"].published) == ("m", dt.datetime(2024, 1, 2, 23, 0)) and got["C"].link is None and got["C"].published is None


def test_batches_in_two_steps(spark):
    rows = [(("a", "b", None)[k % 3 if k % 5 else 0], k) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(7)
    got = {(r.g, r.k): r.batch_id for r in report.batches(df, ["k"], ["g"], 20).collect()}
    for g in ("a", "b", None):
        own = sorted(k for x, k in rows if x == g)
        assert {k: got[g, k] for k in own} == {k: n // 20 for n, k in enumerate(own)}
    assert len(got) == 700 and report.batches(df.limit(0), ["k"], ["g"]).count() == 0


def test_no_window_over_a_bare_group_key(spark):
    plan = plans.batch_50(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "row_number" in line]
    assert windows and all("__part" in line for line in windows)


def test_too_large_a_batch_is_an_error(spark):
    df = spark.createDataFrame([(0, k, f"t{k}") for k in range(4)], "batch_id long, k int, t string")
    with pytest.raises(Exception, match="more than 3"):
        report.call_model(df, model(0), ["t"], ["batch_id"], ["k"], most=3).collect()


def test_report_parts_make_up_the_report(spark):
    sections = spark.createDataFrame([(g, k, f"{g}{k}") for g in ("a", "b") for k in range(7)], "topic string, n int, section string")
    parts = sorted(report.report_parts(sections, ["topic"], ["n"], 3).collect())
    whole = {r.topic: r.report for r in report.article_report(sections, ["topic"], ["n"]).collect()}
    assert [r.n for r in parts if r.topic == "a"] == [3, 3, 1]
    assert {g: "\n".join(r.report for r in parts if r.topic == g) for g in ("a", "b")} == whole


def test_type_and_required_rows(spark):
    df = spark.createDataFrame([(1, " text/html"), (2, "text/plain"), (3, None)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", report.html_only_when(F.lit("raw"), F.col("t"), F.lit("converted")).alias("c")).collect()}
    assert got == {1: "converted", 2: "raw", 3: "raw"}
    assert report.require_rows(df, "rows") is df
    with pytest.raises(ValueError, match="no rows left"):
        report.require_rows(df.limit(0), "rows")


def test_rows_of_a_relational_table(spark, tmp_path):
    """Appended twice to a database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, 0.5, dt.datetime(2024, 1, 1)), (2, None, dt.datetime(2024, 1, 2))], "interval long, metric double, ts timestamp")
    for _ in range(2):
        sinks.jdbc(rows, url, "movement", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = spark.read.format("jdbc").options(url=url, dbtable="movement", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").load()
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(tuple(r) for r in rows.union(rows).collect())


def test_upper_case(spark):
    assert one(spark, "Straße é", text.upper_case) == "STRASSE É"
    assert [one(spark, None, text.upper_case), one(spark, "", text.upper_case)] == [None, ""]


def test_tags_with_and_without_special_characters(spark):
    df = spark.createDataFrame([(1, ["b", "a c", " d* "]), (2, ["b", "a"]), (3, []), (4, None), (5, ["é", None, "z"])], "k int, t array<string>")
    got = {r.k: r.x for r in df.select("k", report.sorted_tags(F.col("t")).alias("x")).collect()}
    assert got == {1: "a c, b, d\\*", 2: "a, b", 3: "", 4: None, 5: "z, é"}


def test_an_answer_leaves_before_the_next_call():
    import pyarrow as pa

    seen = []
    run = report._calls(lambda rows: seen.append(rows) or "{}", ["k"], 1, 0.0)
    out = run(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(['[{"t": 1}]'] * 3)], ["k", "__rows"])]))
    assert next(out).to_pylist() == [{"k": 1, "answer": "{}", "attempts": 1, "exception": None}] and len(seen) == 1
    assert [x.to_pylist()[0]["k"] for x in out] == [2, 3] and len(seen) == 3
