"""The queries against their SQL, on the same tables."""

import duckdb
import pytest

from brindle.llm import queries

SF = "/root/testdata/sf0.001"


def key(value):
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(key(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(key, r)) for r in want.fetchall())


def test_other_queries_run(spark):
    for name in sorted(set(queries.queries()) - set(queries.oracle_sql())):
        assert queries.queries()[name](spark, SF).count() > 0, name
