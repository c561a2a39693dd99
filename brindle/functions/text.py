"""Text shaping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a backslash goes before in Markdown text.
MARKDOWN_SPECIAL = "\\`*_{}[]()#+-.!|<>"


def strip(text: Column) -> Column:
    """Without white space at both ends; Unicode white space counts."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks as one blank."""
    return F.regexp_replace(text, " +", " ")


def capitalise_first(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def upper_case(text: Column) -> Column:
    """The whole text in upper case."""
    return F.upper(text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def bullet(line: Column) -> Column:
    """A list line with the bullet ``*`` in place of its own two first characters."""
    return F.concat(F.lit("* "), F.substr(strip(line), F.lit(3)))


def split_semicolon(line: Column) -> Column:
    """``a; b`` as ``a. B``; a line of other than two parts stays."""
    parts = F.transform(F.split(line, ";"), strip)
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), F.lit(". "), capitalise_first(F.get(parts, F.lit(1))))).otherwise(line)


def escape_markdown(text: Column) -> Column:
    """A backslash before every special character, dollar signs included."""
    special = "".join("\\" + c for c in MARKDOWN_SPECIAL)
    return F.regexp_replace(text, f"([{special}$])", r"\\$1")


def unescape_dollars(text: Column) -> Column:
    return F.replace(text, F.lit("\\$"), F.lit("$"))


def repair_json(answer: Column) -> Column:
    """A model's answer without what surrounds its JSON.

    In this order: white space at the ends, a leading code fence, the word
    ``json`` after it, and what follows the last closing brace if it holds a fence.
    """
    text = strip(answer)
    text = F.regexp_replace(text, r"^```", "")
    text = F.regexp_replace(text, r"^\s*json", "")
    return strip(F.regexp_replace(text, r"(?s)\}[^}]*```[^}]*$", "}"))
