"""Every registered query against its SQL twin, and its join strategies."""

from __future__ import annotations

import pytest

from catalog import all_queries, all_sql
from catalog.compare import compare
from tests.conftest import SF_DIR

QUERIES, SQL = all_queries(), all_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], SQL[name]).startswith("ok")


@pytest.mark.parametrize(
    "name",
    ["labor_index_monthly", "weekly_table", "wages_all_cuts", "hiring", "turnover", "event_significance", "calendar_columns"],
)
def test_no_pairwise_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_anchor_weeks_reach_the_benchmark_free_scan(spark):
    """Date bounds of the report reach the parquet reader."""
    plan = QUERIES["daily_actuals"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_extendedprice" not in plan


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns[:3] == ["year", "month", "reference_sunday"]
