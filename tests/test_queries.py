"""Every query that has SQL gives the rows of that SQL."""

import functools
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from careweave import oracles, queries, table_queries
from careweave.plans import reconciliation

DATA = "/root/testdata/sf0.001"
for name in ("_resolved", "_stitched", "_reconciled"):  # shared steps are run once
    setattr(queries, name, functools.lru_cache(None)(getattr(queries, name)))
reconciliation.run_feeds = functools.lru_cache(None)(reconciliation.run_feeds)
SQL = oracles.ORACLE_SQL | table_queries.ORACLE_SQL


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    show = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in ("events", "orders", "supplier", "lineitem", "customer", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry_and_whole_plan(spark):
    from careweave.sources import feeds

    tables = reconciliation.run_feeds(spark, DATA)
    assert tables.encounters.columns[:2] == ["encounter_id", "patient_key"]
    episodes, filled = reconciliation.with_episodes(tables, feeds.AS_OF)
    assert filled.where("episode_id IS NULL").count() == 0 and tables.encounters.count() == filled.count() > 0
    assert tables.encounters.select("encounter_id").distinct().count() == filled.count()
    assert {r["assertion"]: r["violations"] for r in __spark_entry__.queries()["run_assertions"](spark, DATA).collect()}["detail_has_encounter"] == 0
    assert episodes.count() <= filled.count()


def test_all_are_registered():
    assert set(oracles.ORACLE_SQL) == set(queries.QUERIES) and set(table_queries.ORACLE_SQL) == set(table_queries.QUERIES)
    assert set(SQL) <= set(__spark_entry__.queries())
