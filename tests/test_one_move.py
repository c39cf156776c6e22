"""Rows move once, and are multiplied only after that."""

from __future__ import annotations

import re
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from catalog import base_tables
from laborloom.operators import benchmark, distinct, weekly
from laborloom.sources import star_adapter as sample
from tests.conftest import SF_DIR

EVENTS = "location_id long, state string, event_date date, user_id long, shift_id long, has_clock_in int, unscheduled int, hours_scheduled decimal(8,4), hours_worked decimal(8,4)"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_location_days_move_each_event_once(spark):
    day = date(2000, 1, 3)
    rows = [
        (1, "A", day, 7, 1, 1, 0, 4, 2),
        (1, "A", day, 7, 1, 0, 1, 4, 2),  # the worker and the shift again
        (1, "A", day, 8, 1, 0, 0, 4, None),  # the shift under another worker
        (1, "A", day, None, 2, 1, 0, None, 1),
        (1, "A", day, 9, None, 1, 1, 4, 2),
        (None, None, day, 7, 3, None, None, 4, 2),
    ]
    rows = [(*r[:7], *[None if x is None else Decimal(x) for x in r[7:]]) for r in rows]
    days = benchmark.location_days(spark.createDataFrame(rows, EVENTS), ["state"])
    assert "Expand" not in plan(days) and plan(days).count("Exchange hashpartitioning") == 1
    names = ["users_with_clock_in", "users_with_scheduled_shifts", "total_scheduled_shifts", "total_clock_ins", "scheduled_clock_ins"]
    assert {r["location_id"]: tuple(r[n] for n in names) for r in days.collect()} == {1: (2, 2, 2, 3, 2), None: (0, 0, 0, 0, 0)}


def test_cube_multiplies_label_sets_after_the_move(spark):
    day = date(2000, 1, 3)
    rows = [(day, "i", "A", 0, 3), (day, "i", None, 0, 4), (day + timedelta(days=1), "j", "A", 0, 1)]
    cube = distinct.distinct_workers_cube(spark.createDataFrame(rows, "event_date date, industry string, state string, word long, bits long"))
    # The word's bitmaps, then the sums; the label sets between them move nothing.
    assert "Expand" not in plan(cube) and plan(cube).count("Exchange hashpartitioning") == 2
    found = {(r["industry"], r["state"], r["by_industry"], r["by_state"]): r["workers"] for r in cube.filter("period = 'month'").collect()}
    assert found[None, None, False, False] == 3 and found["i", None, True, False] == 3
    assert found["i", None, True, True] == 1 and found[None, None, False, True] == 1 and found[None, "A", False, True] == 2


def test_worker_counts_in_all_cuts_need_no_move_of_multiplied_rows(spark):
    flags = {f"qualified_for_{name}": F.lit(1) for name in ("jobs", "turnover", "wages")}
    weeks = [date(2000, 1, 2) + timedelta(days=7 * k) for k in range(3)]
    rows = [(1, weeks[1], 7, "B"), (2, weeks[1], 7, "A"), (1, weeks[2], 7, "A"), (2, weeks[0], 8, None), (2, weeks[2], 8, "A")]
    users = spark.createDataFrame(rows, "location_id long, week_start date, user_id long, state string").withColumns(
        {**flags, "shift_rows": F.lit(1), "shift_hours": F.lit(1), "pay_rows": F.lit(1), "archive_mark": F.lit(False)}
    )
    spine = weekly._Spine(date(2000, 6, 1), 52, "sunday")
    counted = weekly.worker_measures(weekly.job_flows(users.repartition(4, "user_id"), spine), weekly.CUT_KEYS, {"national": None, "state": "state"})
    # By worker, then the sums by period.
    assert plan(counted).count("Exchange hashpartitioning") == 2
    new = {(r["segmented_by"], r["segment"], r["period_start"]) for r in counted.filter("workers_new > 0").collect()}
    assert new == {("national", "national", weeks[0]), ("national", "national", weeks[1]), ("state", None, weeks[0]), ("state", "A", weeks[1])}


def test_weekly_rows_move_by_worker_once(spark):
    measures = weekly.period_measures(sample.timeclock(spark, SF_DIR), sample.AS_OF, cuts=weekly.CUTS)
    # The distinct archiving marks, and the rows of workers.
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*user_id", plan(measures))) == 2


def test_years_read_events_that_are_joined_once(spark, tmp_path):
    lines = [(k, k % 3, k % 10, 1 + k % 7, 10.0, 0.0, 0.0, "N", datetime(1999 + k % 3, 1 + k % 12, 5)) for k in range(60)]
    lines += [(1, 1, 4, 2, 10.0, 0.0, 0.0, "N", datetime(2001, 12, 31, 23)), (99, 1, 4, 2, 10.0, 0.0, 0.0, "N", datetime(1998, 1, 1))]
    lines += [(2, 1, 4, 3, 10.0, 0.0, 0.0, "N", None)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    tables = {
        "lineitem": (lines, names),
        "orders": ([(k, k % 5) for k in range(60)] + [(3, 1)], "o_orderkey long, o_custkey long"),
        "nation": ([(k, f"N{k}", 0) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = base_tables.QUERIES["yearly_tables_union"](spark, str(tmp_path))
    # No year joins orders again.
    assert "o_orderkey" not in plan(found) and "Join" not in plan(found)
    expected = Counter()
    for key, _, supplier, *_, at in lines:
        if at is not None and key < 60:
            expected[at.year, supplier // 5] += 2 if key == 3 else 1
    assert {(r["yr"], r["location_id"]): r["shifts"] for r in found.collect()} == expected
    parted = sample.shift_events(spark, str(tmp_path), parts=7).select("shift_id")
    assert parted.count() == sample.shift_events(spark, str(tmp_path)).count()
    assert "hashpartitioning(l_orderkey" in plan(parted) and ", 7)" in plan(parted)
