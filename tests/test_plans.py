"""Every registered query against its SQL counterpart on the smallest tables, plus plan guards."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as registered
from riskloom.plans import catalog
from tools.check import TABLES, compare

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
# Full expected plans of these are Python-side or model fits; they are covered by their own tests too.
ROWS_ONLY = {"logistic", "random_forest", "gbt", "isolation_forest", "investigation", "model_comparison"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def test_every_query_has_sql_or_is_a_model():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    verdict, _, _ = compare(QUERIES[name](spark, SMALL), ORACLES[name], duck)
    assert verdict == "ok", verdict


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_model_queries_return_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in ("logistic", "random_forest", "gbt", "model_comparison"):
        assert {r.split for r in rows} == {"validation", "test"} and all(0 <= r.roc_auc <= 1 for r in rows)
    elif name == "investigation":
        assert len(rows) == spark.read.parquet(f"{SMALL}/orders.parquet").count() and all(r.agrees for r in rows)
    else:
        assert len(rows) == spark.read.parquet(f"{SMALL}/orders.parquet").count() and all(0 <= r.score <= 100 for r in rows)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count() and "c_name" not in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_plans_have_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
