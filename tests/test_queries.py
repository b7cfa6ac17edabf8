"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from plover import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def key(v):
    if v is None or v != v:
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = own.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(key(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(own.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(key(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols
    assert got == want


def test_entry_names():
    import __spark_entry__ as entry

    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
