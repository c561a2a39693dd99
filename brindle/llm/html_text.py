"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block of text, and every line gets a weight:
its characters outside links. Lines of elements that are never part of an
article (menus, forms, adverts, comments ...) weigh nothing and end a window.
Weights are summed over a sliding window of lines; the distribution surges
where text starts and dives where it ends. The heaviest surge-to-dive stretch is
the core.

An element that holds the core as its article is taken with all its lines, lists of
links included. Where no element tells the article from the rest of the page, as on
pages of plain ``div``s, the surge and the dive of the core are its ends: what
lies outside is no text unless it is marked up as such, and light lines at the ends, like
those of a menu above or a notice below, are cut off.

All steps are linear in the size of the page, however deep, unclosed or broken its
markup is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of a window.
WINDOW = 3
#: The core's windows surge at this share of the fullest window.
SURGE = 0.3
#: On pages whose elements do not tell, the text around the core dives at this share.
DIVE = 0.1
#: Share of the core's weight that the chosen element must hold.
HELD = 0.8

#: Elements whose whole content is never article text.
SKIPPED = frozenset("nav footer aside form button select option label fieldset dialog menu object canvas audio video math head".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title noscript template svg textarea iframe".split())
#: Words of a class, id or role that mark such content on any element.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar header footer copyright comment comments disqus"
    " reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay login search widget"
    " pagination pager skip hidden".split()
)
#: Marks that a class of any words may end with.
PAID = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr".split())
#: Words that may stand beside those in a class of several words. A class with any other
#: word, such as ``search-history``, names what a text is about.
BESIDE_MARKS = frozenset(
    "area bar block body bottom box boxes button buttons col column container content count counter field fields global group icon icons inner item items left link links list lists main"
    " module nav outer page panel post posts primary right row secondary section site slot small text title toggle top unit wide wrap wrapper zone".split()
)
#: Marks that hold whatever the element holds.
CERTAIN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus reply replies respond hidden".split())
#: First words of a class that says what is beside the text, and last words of one that names a whole page.
BESIDE = frozenset("has with without no is not".split())
PAGES = frozenset("page layout article post story entry main".split())
#: Elements that break a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr"
    " html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold lines; the others need not be closed.
HOLDERS = frozenset("article aside blockquote body details div dl figure footer form header html main nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening one of the given names ends.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "head": {"body"}}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd td".split())
_TEXT = _PROSE - {"li"}
_WHOLE = frozenset(("root", "html", "body"))
_MAIN = frozenset(("article", "main"))

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTE_OR_END = re.compile(r"""['">]""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?![\w-])", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)(?:hidden\s*=\s*(?:"(?!false")|'(?!false')|(?!["']|false\b))|aria-hidden\s*=\s*["']?true\b|style\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)display\s*:\s*none)""", re.I)
#: What a sentence ends with.
_ENDS = tuple(".!?…:;\"'”’»)]。！？")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: How surely an element is no article text.
_NOT, _LIKELY, _SURE, _CERTAIN = range(4)


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag; "/" before the name of an end tag.

    Comments, declarations and elements of :data:`RAW` come as tags without a
    name. A ">" in quotes ends no tag, unless quotes of the page do not match.
    """
    at, quotes = 0, True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", ""
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", ""
            continue
        found = _NAME.match(page, start + 1)
        if not found:
            at = start + 1
            continue
        end, k = -1, found.end()
        while quotes:
            m = _QUOTE_OR_END.search(page, k)
            if not m:
                quotes = False
            elif m[0] == ">":
                end = m.start()
                break
            else:
                k = page.find(m[0], m.end()) + 1
                quotes = k > 0
        if end < 0:
            end = page.find(">", found.end())
            if end < 0:
                return
        name, at = found[0].lower(), end + 1
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            name = ""
        yield start, at, name, page[found.end() : end]


class _Page:
    """The lines of a page and the elements that hold them."""

    def __init__(self) -> None:
        self.names, self.parents = ["root"], [-1]
        self.looks = [("root", "")]
        self.marks = [_NOT]
        self.texts: list[str] = []
        self.plain: list[int] = []  # characters outside links
        self.holders: list[int] = []
        self.tags: list[str] = []
        self.words: list[str] = []
        self.linked = 0

    def close_line(self, holder: int, tag: str) -> None:
        text = " ".join(html.unescape("".join(self.words)).split())
        if text:
            self.texts.append(text)
            self.plain.append(max(0, len(text) - self.linked))
            self.holders.append(holder)
            self.tags.append(tag)
        self.words, self.linked = [], 0

    def add(self, name: str, parent: int, look: str, mark: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.looks.append((name, look))
        self.marks.append(mark)
        return len(self.names) - 1

    def above(self, holder: int) -> Iterator[int]:
        while holder >= 0:
            yield holder
            holder = self.parents[holder]

    def inside(self, chosen: Sequence[bool]) -> list[bool]:
        """Of each element, whether it or one around it is chosen. Elements come
        after those around them."""
        out = list(chosen)
        for h in range(1, len(out)):
            out[h] = out[h] or out[self.parents[h]]
        return out

    def sums(self, weights: Sequence[int]) -> list[int]:
        """Of each element, the weight of the lines in it."""
        out = [0] * len(self.names)
        for h, n in zip(self.holders, weights, strict=True):
            out[h] += n
        for h in range(len(out) - 1, 0, -1):
            out[self.parents[h]] += out[h]
        return out

    def left_out(self) -> list[bool]:
        """Of each element, whether it is in one that is no article text.

        A mark that may be about the whole page does not count on an element
        that holds more than half of the text: any but the certain ones around an
        article, those of compound classes and forms around whatever it is.
        """
        certain = self.inside([m == _CERTAIN for m in self.marks])
        held = self.sums([0 if certain[h] else n for h, n in zip(self.holders, self.plain, strict=True)])
        holds_main = [0] * len(self.names)
        for h in range(len(self.names) - 1, 0, -1):
            own = self.names[h] in _MAIN and self.marks[h] == _NOT and not certain[h]
            holds_main[self.parents[h]] |= holds_main[h] | own
        most = [2 * n > held[0] for n in held]
        return self.inside([m == _CERTAIN or (m == _SURE and not (most[h] and holds_main[h])) or (m == _LIKELY and not most[h]) for h, m in enumerate(self.marks)])


def _mark(name: str, attributes: str, inside_article: bool) -> int:
    """Whether an element is no article text, by its name and attributes."""
    if name in SKIPPED:
        return _CERTAIN if name in ("aside", "head") else _LIKELY if name in ("form", "fieldset") else _SURE
    if name == "header":
        return _NOT if inside_article else _SURE
    if not attributes or name in ("html", "body"):
        return _NOT
    if _UNSEEN.search(attributes) or _HIDDEN.search(_VALUE.sub("", attributes)):
        return _CERTAIN
    out, tokens = _NOT, [[w.lower() for w in _PARTS.findall(t)] for m in _NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()]
    about = {w for t in tokens for w in t}
    if name in _MAIN:
        return _CERTAIN if about & {"comment", "comments", "reply"} else _NOT
    for words in tokens:
        if not words or words[0] in BESIDE or words[-1] in PAGES:
            continue
        ends = {words[0], words[-1]} & MARKS
        if words[-1] not in PAID and not {w for w in words if len(w) > 1} <= MARKS | BESIDE_MARKS:
            continue
        if inside_article or about & {"article", "post", "entry", "content", "story"}:
            ends -= {"header"}
        if ends:
            out = max(out, _CERTAIN if ends & CERTAIN else _SURE if len(words) == 1 else _LIKELY)
    return out


def _lines(page: str) -> _Page:
    """One pass over the tags of a page; unclosed and stray tags are allowed."""
    out = _Page()
    #: Open elements (name, number, no text) that hold lines or are marked.
    stack: list[tuple[str, int, bool]] = [("root", 0, False)]
    places: dict[str, list[int]] = {}  # of the open elements, by name
    holders = [0]  # places of the open holders
    opened: Counter[str] = Counter()
    dropping, link, last, tag = 0, 0, 0, ""

    def pop_to(place: int) -> None:
        nonlocal dropping
        while len(stack) > place:
            name, _, dropped = stack.pop()
            places[name].pop()
            opened[name] -= 1
            dropping -= dropped
            if holders[-1] == len(stack):
                holders.pop()

    for start, end, name, attributes in _tags(page):
        if not dropping and start > last:
            text = page[last:start]
            out.words.append(text)
            if link:
                out.linked += len(" ".join(text.split()))
        last = end
        if not name:
            continue
        closing = name[0] == "/"
        name = name[1:] if closing else name
        if name in BLOCKS:
            out.close_line(stack[-1][1], tag)
            link = 0
        if name == "a":
            link = 0 if closing else 1
        if closing:
            own = places.get(name)
            if own and (name in HOLDERS or own[-1] > holders[-1]):
                pop_to(own[-1])
            if name == tag:
                tag = ""
            continue
        top = stack[-1][0]
        while top in ENDED_BY and name in ENDED_BY[top] and len(stack) > 1:
            pop_to(len(stack) - 1)
            top = stack[-1][0]
        if name in VOID:
            continue
        mark = _mark(name, attributes, opened["article"] + opened["main"] > 0)
        if mark and attributes.rstrip().endswith("/") and name not in HOLDERS:
            continue
        if mark or name in HOLDERS or opened[name]:
            # What is no block is part of a line: its text is left out at once.
            dropped = mark > 0 and name not in BLOCKS
            number = out.add(name, stack[-1][1], attributes.strip(), mark)
            places.setdefault(name, []).append(len(stack))
            if name in HOLDERS:
                holders.append(len(stack))
            stack.append((name, number, dropped))
            opened[name] += 1
            dropping += dropped
        if name in BLOCKS:
            tag = name
    if not dropping:
        out.words.append(page[last:])
    out.close_line(stack[-1][1], tag)
    return out


def stretches(weights: Sequence[int | None], share: float, firm: Sequence[bool] | None = None) -> list[tuple[int, int]]:
    """The surge-to-dive stretches [first, last) of a distribution of line weights.

    A window sums the weights of up to ``WINDOW`` lines and does not reach over
    a line of weight None. It surges at ``share`` of the fullest window, or at any
    weight. A stretch goes from the first to the last weighty line of its windows;
    with ``firm`` from the first to the last one that is firm or weighs a line's
    part of the core's surge, so light lines that a window only reaches are outside.
    """
    runs, first = [], None
    for k, w in enumerate([*weights, None]):
        if w is None:
            if first is not None:
                runs.append((first, k))
            first = None
        elif first is None:
            first = k
    total = [0, *accumulate(w or 0 for w in weights)]
    window = lambda k, end: total[min(k + WINDOW, end)] - total[k]
    fullest = max((window(k, end) for first, end in runs for k in range(first, end)), default=0)
    least, heavy = max(1.0, share * fullest), SURGE * fullest / WINDOW
    out = []
    for first, end in runs:
        k = first
        while k < end:
            if window(k, end) < least:
                k += 1
                continue
            surge = k
            while k < end and window(k, end) >= least:
                k += 1
            dive = min(end, k + WINDOW - 1)
            while not weights[surge]:
                surge += 1
            while not weights[dive - 1]:
                dive -= 1
            after = dive
            if firm is not None:
                while surge < dive and (weights[surge] or 0) < heavy and not firm[surge]:
                    surge += 1
                while surge < dive and (weights[dive - 1] or 0) < heavy and not firm[dive - 1]:
                    dive -= 1
            if surge < dive:
                out.append((surge, dive))
            k = max(k, after)
    return out


def _element(page: _Page, core: tuple[int, int], weights: Sequence[int | None]) -> int:
    """The element of the article whose core is given: around it, the nearest
    article or main; else the innermost one that holds the core, or one around
    that which has text of its own or more parts that look the same."""
    of_core = page.sums([(w or 0) if core[0] <= k < core[1] else 0 for k, w in enumerate(weights)])
    # Elements are numbered as they open, so the innermost one has the highest number.
    best = max(h for h, n in enumerate(of_core) if n >= HELD * of_core[0])
    around = next((h for h in page.above(best) if page.names[h] in _MAIN), None)
    if around is not None:
        return around
    has_text = [False] * len(page.names)
    looks: dict[int, Counter] = {}
    held = page.sums([w or 0 for w in weights])
    for h, w, tag in zip(page.holders, weights, page.tags, strict=True):
        has_text[h] = has_text[h] or bool(w and tag in _PROSE)
    for h in range(1, len(page.names)):
        if held[h]:
            looks.setdefault(page.parents[h], Counter())[page.looks[h]] += 1
    n_lines = Counter(page.holders)
    while True:
        parent = page.parents[best]
        if page.names[best] in _WHOLE:
            return best
        if page.names[parent] in _WHOLE:
            # One line among others of its kind is a paragraph, not the article's element.
            return parent if n_lines[best] == 1 and looks[parent][page.looks[best]] > 1 else best
        if not has_text[parent] and looks[parent][page.looks[best]] < 2:
            return best
        best = parent


def main_text(page: str | None) -> str:
    """The article of one page; '' for a null page or one without text."""
    if not page:
        return ""
    lines = _lines(page)
    n = len(lines.texts)
    left_out = lines.left_out()
    # A paragraph that is a link as a whole still is one.
    own = [max(p, int(t in _TEXT)) for p, t in zip(lines.plain, lines.tags, strict=True)]
    if not any(w for w, h in zip(own, lines.holders, strict=True) if not left_out[h]):
        own = [len(t) for t in lines.texts]
    weights: list[int | None] = [None if left_out[h] else w for w, h in zip(own, lines.holders, strict=True)]
    firm = [t in _PROSE or (x.endswith(_ENDS) and not x.startswith("©")) for t, x in zip(lines.tags, lines.texts, strict=True)]
    found = stretches(weights, SURGE, firm)
    if not found:
        return ""
    in_main = lines.inside([name in _MAIN for name in lines.names])
    mass = [0, *accumulate((w or 0) * (2 if in_main[h] else 1) for w, h in zip(weights, lines.holders, strict=True))]
    core = max(found, key=lambda s: (mass[s[1]] - mass[s[0]], -s[0]))
    chosen = _element(lines, core, weights)
    if lines.names[chosen] in _WHOLE:
        core = _joined(stretches(weights, DIVE, firm), core, weights)
        # Beside the core, only what is marked up as text.
        weights = [w if core[0] <= k < core[1] or (lines.tags[k] in _PROSE and 2 * lines.plain[k] >= len(lines.texts[k])) else None for k, w in enumerate(weights)]
    else:
        # All of the element's lines count with all their characters, links included.
        inside = lines.inside([h == chosen for h in range(len(lines.names))])
        weights = [None if w is None or not inside[h] else len(lines.texts[k]) for k, (w, h) in enumerate(zip(weights, lines.holders, strict=True))]
    return " ".join(lines.texts[k] for first, last in stretches(weights, 0) for k in range(first, last))


def _joined(found: Sequence[tuple[int, int]], core: tuple[int, int], weights: Sequence[int | None]) -> tuple[int, int]:
    """The core with the stretches over it, and those beside it that a window's few light
    lines part from it."""
    first, last = core
    near = lambda a, b: b - a <= WINDOW and None not in weights[a:b]
    for s, e in found:
        if e > last and near(last, s):
            last = e
    for s, e in reversed(found):
        if s < first and near(e, first):
            first = s
    return first, last


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text_col``, which replaces a column of that name.

    A null or empty page, or one whose text is all menus and the like, has ''. Rows
    are independent, repeated ones get the same text, and nothing is shuffled; an empty
    table stays empty. Pages of any length are read whole, in linear time; other columns
    stay as they are.
    """
    return pages.withColumn(text_col, _main_texts(F.col(f"`{html_col}`").cast("string")))
