"""Every registered query with an oracle agrees with DuckDB on sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from fixture_paths import SF
from graphssl.plans.catalog import QUERIES
from graphssl.plans.oracle import SQL

TABLES = ["embeddings", "labels"]


def _norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


_CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(m in plan for m in _CROSS), plan


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    _no_cross_join(sdf)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == exp


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"id", "grp", "prediction"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"classify"}))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    _no_cross_join(df)
    assert df.count() > 0
