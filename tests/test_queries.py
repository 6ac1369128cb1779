"""Every registered raster, vector and learning query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quadrille import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, D)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
