"""Every query against its SQL, on the same tables."""

import math

import duckdb
import pytest

from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.5f}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(key(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    data = want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, data)
    if data:
        kinds = {c: type(next((r[k] for r in data if r[k] is not None), None)) for k, c in enumerate(columns)}
        own = {c: type(next((r[c] for r in got if r[c] is not None), None)) for c in df.columns}
        assert kinds == own


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
