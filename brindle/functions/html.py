"""HTML fragments: titles and document assembly as column expressions, and
Markdown conversion in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import partial
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.rows import each
from brindle.functions.text import collapse_spaces, strip

#: Header levels in order of preference for a title.
HEADERS = ("h1", "h2", "h3")


def _element_text(page: Column, tag: str) -> Column:
    """Text of the first ``tag`` element without inner tags; null without one."""
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    inner = F.regexp_extract(page, pattern, 1)
    return F.when(page.rlike(pattern), strip(F.regexp_replace(inner, "<[^>]+>", "")))


def title_element(page: Column) -> Column:
    return _element_text(page, "title")


def first_header(page: Column) -> Column:
    """The first h1, or else the first h2, or else the first h3."""
    return F.coalesce(*(_element_text(page, tag) for tag in HEADERS))


def resolve_title(page: Column, title: Column | None = None) -> Column:
    """The given title, or else the title element, or else a header, or null."""
    return F.coalesce(*([title] if title is not None else []), title_element(page), first_header(page))


def title_tag(page: Column, title: Column | None = None) -> Column:
    """``<title>...</title>`` with single blanks, or '' without any title."""
    found = resolve_title(page, title)
    return F.when(found.isNotNull(), collapse_spaces(F.concat(F.lit("<title>"), found, F.lit("</title>")))).otherwise("")


def wrap_body(page: Column) -> Column:
    return F.when(page.contains("<body>"), page).otherwise(F.concat(F.lit("<body>\n"), page, F.lit("\n</body>")))


def build_head(page: Column, ai_content: str | None = "none", title: Column | None = None) -> Column:
    """A head section with the title, and the ``ai-content`` mark unless None."""
    tag = title_tag(page, title)
    lines = [F.lit("<head>"), F.when(F.trim(tag) != "", F.concat(F.lit("\t"), tag))]
    if ai_content is not None:
        lines.append(F.lit(f'\t<meta name="ai-content" content="{escape(ai_content)}">'))
    return F.concat_ws("\n", *lines, F.lit("</head>"))


def insert_doctype(page: Column) -> Column:
    return F.when(page.contains("<!DOCTYPE html>"), page).otherwise(F.concat(F.lit("<!DOCTYPE html>\n"), page))


def assemble(page: Column, ai_content: str | None = "none", title: Column | None = None) -> Column:
    """Body, then head, then doctype, each only where it is missing. A page that
    has a head keeps it."""
    body = wrap_body(page)
    headed = F.when(body.contains("<head>"), body).otherwise(F.concat(build_head(body, ai_content, title), F.lit("\n"), body))
    return insert_doctype(headed)


#: White space of HTML; other blanks, such as no-break ones, are text.
_BLANKS = " \t\n\f\r"
_BLANK_RUN = re.compile(f"[{_BLANKS}]+")


def _one_line(text: str) -> str:
    return _BLANK_RUN.sub(" ", text)


class _ToMarkdown(HTMLParser):
    _LEVELS = {f"h{k}": "#" * k + " " for k in range(1, 7)}
    _MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
    _SKIPPED = frozenset(("script", "style", "head"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.links: list[str] = []
        self.skipped = 0
        self.head_ends = True

    def feed(self, data):
        """A head without end tag, which HTML allows, takes nothing with it."""
        self.head_ends = re.search("</head", data, re.IGNORECASE) is not None
        super().feed(data)

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIPPED and (tag != "head" or self.head_ends):
            self.skipped += 1
        if self.skipped:
            return
        self.end_text()
        if tag in self._LEVELS:
            self.out.append("\n\n" + self._LEVELS[tag])
        elif tag in ("p", "div", "article", "section", "ul", "ol", "blockquote"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in self._MARKS:
            self.out.append(self._MARKS[tag])
        elif tag == "a":
            self.links.append(_one_line(dict(attrs).get("href") or ""))
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in self._SKIPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped:
            return
        self.end_text()
        if tag in self._LEVELS or tag in ("p", "ul", "ol"):
            self.out.append("\n\n")
        elif tag in self._MARKS:
            self.out.append(self._MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)

    def end_text(self):
        """Blanks around a comment or a skipped element are one run."""
        if self.text:
            self.out.append(_one_line("".join(self.text)))
            self.text.clear()

    def close(self):
        super().close()
        self.end_text()

    def parse_marked_section(self, i, report=1):
        """Up to the next ``>``, as browsers do; the library's own ends with an error for most."""
        return self.parse_bogus_comment(i)


def to_markdown_text(page: str | None, references: Mapping[str, str] | None = None) -> str | None:
    """Headers, paragraphs, lists, links and emphasis of one HTML text.

    All character references of HTML are decoded, some of them also without their
    semicolon. With ``references`` (such as ``{"&quot;": '"'}``) only those are, the
    longest that fits, and all others stay as they are written.
    """
    if page is None:
        return None
    parser = _ToMarkdown()
    # An escaped ampersand comes out of the parser as it stood in the page.
    parser.feed(page if references is None else page.replace("&", "&amp;"))
    parser.close()
    text = "".join(parser.out)
    if references:
        known = "|".join(re.escape(r) for r in sorted(references, key=len, reverse=True))
        text = re.sub(known, lambda m: references[m[0]], text)
    lines = [line.strip(_BLANKS) for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(_BLANKS)


def _inline(text: str) -> str:
    text = escape(text, quote=False)
    text = re.sub(r"\[([^\]]*)\]\(([^)\s]*)\)", lambda m: f'<a href="{m[2]}">{m[1]}</a>', text)
    text = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)
    return re.sub(r"(?<!\\)\*([^*]+)\*", r"<em>\1</em>", text)


def to_html_text(markdown: str | None) -> str | None:
    """Headers, ``*`` lists, emphasis, links and paragraphs of one Markdown text;
    ``\\$`` becomes ``$``."""
    if markdown is None:
        return None
    out: list[str] = []
    for block in re.split(r"\n\s*\n", markdown.strip()):
        lines = [line for line in block.split("\n") if line.strip()]
        while lines:
            if header := re.match(r"(#{1,6}) +(.*)", lines[0]):
                out.append(f"<h{len(header[1])}>{_inline(header[2].strip())}</h{len(header[1])}>")
                lines = lines[1:]
                continue
            is_item = lines[0].startswith("* ")
            n = next((k for k, line in enumerate(lines) if line.startswith("* ") != is_item or re.match(r"#{1,6} ", line)), len(lines))
            part, lines = lines[:n], lines[n:]
            if is_item:
                out.append("<ul>\n" + "\n".join(f"<li>{_inline(line[2:].strip())}</li>" for line in part) + "\n</ul>")
            else:
                out.append(f"<p>{_inline(chr(10).join(part))}</p>")
    return "\n".join(out).replace("\\$", "$")


def markdown_converter(references: Mapping[str, str] | None = None):
    """An Arrow UDF of :func:`to_markdown_text`."""

    @F.arrow_udf(T.StringType())
    def convert(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each(partial(to_markdown_text, references=references))(pages)

    return convert


html_to_markdown = markdown_converter()


@F.arrow_udf(T.StringType())
def markdown_to_html(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return each(to_html_text)(texts)
