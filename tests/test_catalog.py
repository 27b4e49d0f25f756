"""Each driver query against its oracle, and the plans of the hot path."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from read_parquet('{SF}/{file}')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), list(want.columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 34


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["filter_session"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_type" in plan and "event_id" not in plan  # only the columns that are needed are read


def test_score_plan_has_no_shuffle_and_no_python(spark):
    plan = entry.queries()["semantic_threshold"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
