"""Every query of the graph library against its SQL, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from loomgraph.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert got == table(r.columns, r.fetchall())


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
