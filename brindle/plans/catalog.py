"""Query catalogue: name -> query, and name -> the SQL that must agree with it."""

from __future__ import annotations

from brindle.plans import crowd, emotion, files, fuzzy, report, rules
from brindle.plans.common import Query

_PARTS = (crowd.catalogue, emotion.catalogue, fuzzy.catalogue, rules.catalogue, report.catalogue, files.catalogue)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
