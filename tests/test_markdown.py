"""Pages with odd texts to Markdown: the queries give what their SQL gives."""

import duckdb
import pytest

from brindle.functions import html
from brindle.plans import catalog

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title></head><body><nav><ul><li><a href="/{0}">{0}</a></li></ul></nav>'
    '<!-- ad --><div class="ad">{0}</div><article><h1>{0}</h1><p><b>{0}</b> {0}<br>{0}<p>{0} <!-- b --> {0}</p></article><footer>&copy; {0} &middot; x</footer>'
)
CUT = ["and &quot;b&quot", "&quo", "&amp;&amp", "&am", "&a", "&", "&copy", "&middot", "&lt", "&lt;b&gt;", "&#39;", "&amp;quot;", "&ampquot;", "&notit;"]
BLANK = ["a\u00a0", "\u2003b", "a \t\r\n b", "\x0bc\x1f", "\u0085", " \f "]
ODD = [None, "", "plain &quot", "a<![if x]>b<![endif]>c", "<html><head><title>t</title><body><p>a</p>", *(PAGE.replace("{0}", x) for x in CUT + BLANK)]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(ODD)), "page_id bigint, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    turns = [(1, 1, "a &quot b&amp;"), (1, 2, None), (2, 1, "<b>x</b>")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, text string").coalesce(1).write.parquet(f"{root}/conversations.parquet")
    return root


def both(spark, root, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet/*.parquet'")
    return {tuple(r) for r in catalog.queries()[name](spark, root).collect()}, set(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_content_by_type_of_odd_pages(spark, odd_dir):
    got, want = both(spark, odd_dir, "content_by_type_html")
    assert got == want and len(got) == len(ODD) + 3


def test_markdown_of_odd_pages(spark, odd_dir):
    got, want = both(spark, odd_dir, "html_to_markdown")
    assert got == want and len(got) == len(ODD)


def test_references_that_are_decoded():
    page = "<h1>&lt;a&gt; &quot</h1><p>&quot;b&quot; &amp;quot; &amp"
    assert html.to_markdown_text(page) == '# <a> "\n\n"b" &quot; &'
    assert html.to_markdown_text(page, {"&quot;": '"', "&amp;": "&", "&amp": "&"}) == '# &lt;a&gt; &quot\n\n"b" &quot; &'
    assert html.to_markdown_text(page, {}) == "# &lt;a&gt; &quot\n\n&quot;b&quot; &amp;quot; &amp"


def test_blanks_of_a_page():
    assert html.to_markdown_text("<p>a\u00a0 \n b\u00a0</p>") == "a\u00a0 b\u00a0"
    assert html.to_markdown_text('a <!-- x --> <script>y</script> b <a href="u\n v">w</a>') == "a b [w](u v)"
