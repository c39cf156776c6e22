"""Reports from the bucketed layout equal those from events, without the exchanges; roster joins likewise."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from catalog.compare import _bag
from laborloom.operators import weekly
from laborloom.operators.qualify import qualified_weeks
from laborloom.plans.weekly_layout import WeeklyLayout
from laborloom.sources.layout import Bucketed, part_of
from tests.test_weekly import SCHEMA, _rows

AS_OF = date(2001, 9, 30)
CUTS = {"national": None, "state": "state"}


def _plan(df):
    """The plan before adaptive changes, which only ever take exchanges away."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    frame = spark.createDataFrame(_rows(), SCHEMA)
    made = WeeklyLayout(spark, str(tmp_path_factory.mktemp("layout")), "t_layout", ["state"], buckets=3, parts=4)
    made.store(frame)
    # No side is small enough to be sent to all tasks, as it would be on large data.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield frame, made
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for name in ("locations", "flags", "workers"):
        made._table(name).drop(spark)


@pytest.mark.parametrize("options", [{}, {"by": ["state"]}, {"cuts": CUTS}, {"lookback_weeks": 4, "literal_survival": True}])
def test_same_rows_as_from_events(layout, options):
    frame, made = layout
    ours, theirs = made.weekly_table(AS_OF, **options), weekly.weekly_table(frame, AS_OF, **options)
    columns = sorted(ours.columns)
    assert _bag(ours.select(*columns).collect(), columns) == _bag(theirs.select(*columns).collect(), columns)


def test_flag_join_and_windows_have_no_exchange(layout):
    _, made = layout
    spine = weekly._Spine(AS_OF, 260, "sunday")
    joined = made.flagged_workers(AS_OF)
    assert "SortMergeJoin" in _plan(joined) and "Exchange" not in _plan(joined)
    flows = weekly.job_flows(joined, spine, within=["part"])
    assert "Window" in _plan(flows) and "Exchange" not in _plan(flows)
    # Qualification, from the stored totals, and its look-ahead.
    flags = made.location_flags()
    totals = flags.select("location_id", "week_start", "weekly_employees", "hours", "rated_hours", "archived_this_week")
    assert "Window" in _plan(qualified_weeks(totals)) and "Exchange" not in _plan(qualified_weeks(totals))
    ahead = _plan(weekly.location_measures(flags, spine))
    assert ahead.count("Exchange") == 1  # of periods
    assert "Exchange hashpartitioning(location_id" in _plan(weekly.location_measures(qualified_weeks(totals.withColumn("shift_rows", F.lit(1)).withColumn("user_shift_rows", F.lit(1)).withColumn("pay", F.lit(1)).withColumn("pay_hours", F.lit(1)).repartition(5)), spine))


def test_a_large_location_lies_in_many_buckets(spark, layout):
    _, made = layout
    many = spark.range(8000).select(F.lit(7).cast("long").alias("location_id"), part_of("id", 16).alias("part"))
    assert many.groupBy("part").count().agg(F.max("count")).first()[0] < 8000 / 16 * 1.4
    rows = Counter(r["location_id"] for r in made._table("workers").read(spark).select("location_id").collect())
    assert rows


def test_a_new_session_finds_the_layout(spark, layout):
    _, made = layout
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("flags", "workers"):
        made._table(name).drop(spark)
    again = WeeklyLayout(fresh, made.folder, "t_again", ["state"], buckets=3, parts=4)
    joined = again.flagged_workers(AS_OF)
    assert joined.count() > 0 and "Exchange" not in _plan(joined)
    for name in ("flags", "workers"):
        again._table(name).drop(fresh)


def test_roster_joins_meet_in_buckets(spark, layout, tmp_path):
    """Shifts stored by roster id and the roster by its own id: the shift build joins them in place."""
    shifts = spark.range(500).select("id", (F.col("id") % 50).alias("job_id"), F.lit(datetime(2001, 1, 1)).alias("start_at"))
    jobs = spark.range(50).select(F.col("id").alias("job_id"), (F.col("id") * 3).alias("user_id"))
    left = Bucketed("t_shifts", str(tmp_path / "s"), ("job_id",), 3)
    right = Bucketed("t_jobs", str(tmp_path / "j"), ("job_id",), 3)
    joined = left.write(shifts).join(right.write(jobs), "job_id")
    assert joined.count() == 500 and "Exchange" not in _plan(joined)
    left.drop(spark)
    right.drop(spark)
