"""Prompt texts for the two model stages, and how a batch is put into one."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

SUMMARY_LINES, LEAST_TAGS, MOST_TAGS = 3, 5, 20

SUMMARISE = f"""You are given news articles as a JSON list. For each article write exactly {SUMMARY_LINES} short
summary sentences and from {LEAST_TAGS} to {MOST_TAGS} tags. Copy title, link and publish_date as they are.
Answer with one JSON object and nothing else:
{{"articles": [{{"title": "...", "link": "...", "publish_date": "...", "summary": ["..."], "tags": ["..."]}}]}}"""

STRATEGY = """You are given a report of article summaries in Markdown. Derive what a reader should do next.
Answer with a plain Markdown list, one line per recommendation: what to do; why."""


def with_rows(prompt: str, rows: Sequence[dict]) -> str:
    """The prompt followed by a batch as indented JSON."""
    return f"{prompt}\n\n{json.dumps(list(rows), indent=4, ensure_ascii=False)}"


def model_from(complete: Callable[[str], str], prompt: str = SUMMARISE) -> Callable[[list[dict]], str]:
    """A model for batches out of a function from prompt text to answer text."""
    return lambda rows: complete(with_rows(prompt, rows))
