"""Every named query against its SQL counterpart, and against plans that do not scale."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import oracles
from farpoint.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "events embeddings orders lineitem".split()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(SQL) <= set(QUERIES) and set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["window_id", "seq", "event_id", "succ", "prev", "status"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    places = [names.index(c) for c in df.columns]
    assert Counter(rows) == Counter(tuple(r[i] for i in places) for r in result.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["plausible_rows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,1.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan
