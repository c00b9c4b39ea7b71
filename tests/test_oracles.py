"""Every registered query of the market engine against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quantspark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{smallest}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5e}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, smallest, name):
    df = QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want


def test_queries_without_sql_give_rows(spark, smallest):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, smallest).count() > 0


def test_flagship(spark, smallest):
    assert registry.flagship(spark, smallest).count() > 0
