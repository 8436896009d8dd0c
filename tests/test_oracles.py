"""Every query with SQL against DuckDB on sf0.001."""

import math

import duckdb
import pytest

from factloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    got = [dict(zip(df.columns, r)) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    key = sorted(cols)
    assert sorted(tuple(plain(r[c]) for c in key) for r in got) == sorted(tuple(plain(r[c]) for c in key) for r in want)
