"""Every query against its SQL in DuckDB, on the small tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(SQL[name])
    want = normal([c[0] for c in rel.description], rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and df.columns
