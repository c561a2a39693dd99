import random
import time
from html.parser import HTMLParser

import pytest

from brindle.llm import html_text
from brindle.llm.html_text import WINDOW, extract, main_text, stretches

LONG = "This sentence is one of those that make up the text of an article. "
PAGE = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p{{x}}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG * 9}</p></div>
<article><header><h1>Heading</h1></header><p>{LONG}<br>a &amp; b&nbsp;c &#233; &lt;tag&gt;</p>
<script>var t="</p>";track();</script><!-- <p>comment</p> --><div class=ad>Buy</div>
<p>Short.</p><form><p>Name <input></p></form><p><b>Bo</b>ld {LONG}</article>
<aside>Side {LONG * 5}</aside><div id="comments"><p>{LONG * 20}</p></div>
<footer>&copy; me</footer></body></html>"""


def test_article_only():
    want = f"Heading {LONG.strip()} a & b c é <tag> Short. Bold {LONG.strip()}"
    assert main_text(PAGE) == want


def test_page_without_semantic_elements():
    page = f"<body><div class=menu><a>One</a> <a>Two</a></div><div id=content><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class='sidebar'><p>{LONG * 9}</p></div><div>tiny</div></body>"
    assert main_text(page) == f"Head {LONG}{LONG}End."


def test_links_are_not_the_core():
    links = "".join(f"<li><a href=/{k}>{LONG}</a></li>" for k in range(9))
    assert main_text(f"<body><ul>{links}</ul><div><p>{LONG}</p><p>Next.</p></div></body>") == f"{LONG}Next."


@pytest.mark.parametrize("page", [None, "", "   ", "<nav>only a menu</nav>", "<script>x", "<!-- open", "<p title=\"open>x"])
def test_nothing_to_extract_does_not_fail(page):
    assert isinstance(main_text(page), str)


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (None, None, None, None), (2, "v", "<p>" + "word " * 60000, "x")], "page_id long, url string, html string, text string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = [(r.page_id, r.text) for r in out.collect()]
    assert got.count((1, main_text(PAGE))) == 2 and (None, "") in got and (2, ("word " * 60000).strip()) in got
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='layout with-sidebar'><article><p>{LONG}</p><p>End.</p></article></div></body>",
        f"<body><div id='page' class='has-header'><div class=content><p>{LONG}</p><p>End.</p></div></div></body>",
        f"<body><div class='search-result-page'><p>{LONG}</p><p>End.</p></div></body>",
        f"<body><form id=aspnet><div><p>{LONG}</p><p>End.</p></div></form></body>",
        f"<body><nav><a href=/>Home</a><article><p>{LONG}</p><p>End.</p></article></body>",
    ],
)
def test_marks_on_wrappers(page):
    assert main_text(page) == f"{LONG}End."


def test_lists_and_sections_of_an_article():
    items = "".join(f"<li>{LONG}</li>" for _ in range(9))
    page = f"<body><div id=menu><a href=/>x</a></div><div id=content><p>Intro.</p><ul>{items}</ul><p>End.</p></div><div class=cookie-bar>{LONG * 3}</div><div>tiny</div></body>"
    assert main_text(page) == f"Intro. {LONG * 9}End."
    parts = f"<div class=part><p>{LONG}</p></div><div class=ad>Buy</div>" * 4
    assert main_text(f"<body><div class=post><h2>Head</h2>{parts}</div><div class=side><p>Other</p></div></body>") == f"Head {LONG * 4}".strip()


def brute_stretches(weights, share):
    """Line by line: a line is kept if a full enough window has weight on both sides of it or at it."""
    n = len(weights)
    windows = []
    for k in range(n):
        own = []
        for j in range(k, min(k + WINDOW, n)):
            if weights[j] is None:
                break
            own.append(j)
        windows.append(own)
    sums = [sum(weights[j] for j in own) for own in windows]
    least = max(1, share * max(sums, default=0))
    out, k = [], 0
    while k < n:
        if weights[k] is None or sums[k] < least:
            k += 1
            continue
        lines = set()
        while k < n and weights[k] is not None and sums[k] >= least:
            lines |= set(windows[k])
            k += 1
        weighty = [j for j in lines if weights[j]]
        out.append((min(weighty), max(weighty) + 1))
        k = max(k, out[-1][1])
    return out


def test_stretches_match_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        weights = [rng.choice((None, 0, 0, 0, 1, 5, 80, 300)) for _ in range(rng.randrange(0, 25))]
        for share in (0, 0.3):
            assert stretches(weights, share) == brute_stretches(weights, share), (weights, share)


class Article(HTMLParser):
    """The text of the article element of the pages of the tables."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "br", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def pages(spark):
    return [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]


def test_pages_of_the_table(spark):
    for key, page in pages(spark):
        parser = Article()
        parser.feed(page)
        assert main_text(page) == " ".join(" ".join(b.split()) for b in parser.blocks if b.split()), key


@pytest.mark.parametrize("other", [lambda w, share, firm=None: [(0, len(w))], lambda w, share, firm=None: [(k := max(range(len(w)), key=lambda i: w[i] or 0), k + 1)], lambda w, share, firm=None: []])
def test_the_distribution_decides(spark, monkeypatch, other):
    own = {key: main_text(page) for key, page in pages(spark)}
    monkeypatch.setattr(html_text, "stretches", other)
    assert all(main_text(page) != own[key] for key, page in pages(spark))


@pytest.mark.parametrize(
    "unit",
    ["<div>", "<head>", "<a title=\"x ", "<a \">\" ", "<p class=ad>x", "<", "<span class=ad>x", "<div><p>t</div>", "</p></div>", "<!--", "<!a ", "<script>", "<div class='a-b'>x", "&amp"],
)
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit)) + "text"
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 8


def lines_of(rng, n, low, high):
    words = "stone river cloud green house paper light metal forest window".split()
    return [(" ".join(rng.choice(words) for _ in range(rng.randrange(low, high)))).capitalize() for _ in range(n)]


def plain_pages(n=200):
    """(page, article) of pages of plain elements: nothing marks menus above and notices below."""
    rng, out = random.Random(11), []
    for k in range(n):
        menu, foot = lines_of(rng, rng.randrange(1, 9), 1, 3), lines_of(rng, rng.randrange(1, 6), 2, 4)
        text = [line + "." for line in lines_of(rng, rng.randrange(2, 9), 30, 90)]
        # Short lines inside: headings and remarks.
        for line in lines_of(rng, rng.randrange(0, 4), 1, 4):
            text.insert(rng.randrange(1, len(text)), line)
        tags = {"menu": "div", "text": ("div", "p")[k % 2], "foot": "div"}
        own = lambda rows, kind: "".join(f"<{tags[kind]}>{r}</{tags[kind]}>" for r in rows)  # noqa: E731, B023
        out.append((f"<html><body>{own(menu, 'menu')}{own(text, 'text')}{own([*foot, '© 2024 Site'], 'foot')}</body></html>", " ".join(text)))
    return out


def test_unmarked_menus_and_notices_are_cut_off():
    for page, want in plain_pages():
        assert main_text(page) == want


@pytest.mark.parametrize(
    ("name", "value", "share"),
    [
        # Every line that the marks have left, whatever it weighs: the marks stay.
        ("stretches", lambda w, share, firm=None: [(k, k + 1) for k, x in enumerate(w) if x is not None], 0.95),
        # The same with all such lines as the core.
        ("stretches", lambda w, share, firm=None: [(0, len(w))] if share else stretches(w, share), 0.95),
        ("stretches", lambda w, share, firm=None: [(k := max(range(len(w)), key=lambda i: w[i] or 0), k + 1)] if share else stretches(w, share), 0.4),
        ("WINDOW", 1, 0.15),
        ("SURGE", 0.0, 0.2),
    ],
)
def test_the_distribution_decides_on_plain_pages(monkeypatch, name, value, share):
    pages = plain_pages()
    monkeypatch.setattr(html_text, name, value)
    assert sum(main_text(page) != want for page, want in pages) >= share * len(pages)


def test_lists_of_links_in_an_article_stay():
    links = "".join(f"<li><a href=/{k}>Source {k}</a></li>" for k in range(5))
    listed = " ".join(f"Source {k}" for k in range(5))
    assert main_text(f"<body><article><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p></article></body>") == f"{LONG}{listed} {LONG}".strip()
    assert main_text(f"<body><nav>Menu</nav><article><p>{LONG}</p><h2>Sources</h2><ul>{links}</ul></article></body>") == f"{LONG}Sources {listed}"
    divs = "".join(f"<div><a href=/{k}>Source {k}</a></div>" for k in range(3))
    assert main_text(f"<body><div id=content><p>{LONG}</p>{divs}<p>{LONG}</p></div><div class=sidebar>x</div></body>") == f"{LONG}Source 0 Source 1 Source 2 {LONG}".strip()


@pytest.mark.parametrize(
    "name",
    "search-algorithms social-impact alert-fatigue hidden-gems search-history menu-planning share-price widget-theory reply-rate notice-period comment-culture banner-headlines login-records cookie-recipes".split(),
)
def test_sections_named_by_their_subject_stay(name):
    for attribute in (f"id={name}", f"class='{name}'", f'id="{name}"'):
        assert main_text(f"<body><article><p>{LONG}</p><section {attribute}><p>{LONG}</p></section><p>End.</p></article></body>") == f"{LONG}{LONG}End."


@pytest.mark.parametrize("name", "ad ad-container google-ad cookie-bar related-posts share-buttons social-links newsletter-signup comment-list ad-300x250 siteFooter nav_menu".split())
def test_named_boilerplate_goes(name):
    assert main_text(f"<body><article><p>{LONG}</p><div class='{name}'><p>Buy this now.</p></div><p>End.</p></article></body>") == f"{LONG}End."


@pytest.mark.parametrize("attributes", ["hidden", "hidden=''", "aria-hidden=true", "style='color:red; display: none'", "hidden=hidden"])
def test_unseen_elements_go(attributes):
    assert main_text(f"<body><article><p>{LONG}</p><div {attributes}><p>Unseen.</p></div><p>End.</p></article></body>") == f"{LONG}End."


@pytest.mark.parametrize("attributes", ["title='hidden'", "data-hidden=x", "aria-hidden=false", "style='display:block'"])
def test_seen_elements_stay(attributes):
    assert main_text(f"<body><article><p>{LONG}</p><div {attributes}><p>Seen.</p></div><p>End.</p></article></body>") == f"{LONG}Seen. End."
