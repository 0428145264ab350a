"""Every query against its SQL, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from catalyte import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    if name in queries.ORACLE_SQL:
        rel = con.sql(queries.ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_url_sanity_returns_the_operators_rows(spark, monkeypatch):
    monkeypatch.setattr(queries.ingest, "bad_urls", lambda df, *_: df.limit(3))
    assert queries.QUERIES["url_sanity"](spark, SMALL).count() == 3
