"""Every registered query with SQL against DuckDB on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from lakeloom import queries as engine

from .conftest import SF

QUERIES, SQL = engine.queries(), engine.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return repr(v + 0.0) if isinstance(v, float) else f"{type(v).__name__}:{v}"


def rows(names, columns, values):
    at = [columns.index(n) for n in names]
    return sorted(tuple(plain(r[i]) for i in at) for r in values)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in engine.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == names
    assert rows(names, df.columns, df.collect()) == rows(names, want.columns, want.fetchall())


def test_without_sql(spark):
    """Queries beyond SQL: the index joins are held against exact ones in test_engine."""
    clusters = QUERIES["group_by_near"](spark, SF).collect()
    assert sum(r.n for r in clusters) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and len(clusters) <= 21
    assert QUERIES["ivf_topk"](spark, SF).count() == 20
