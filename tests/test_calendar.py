from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laborloom import periods
from laborloom.functions import calendar as cal


def test_report_anchor_switches_after_the_27th():
    assert periods.report_anchor(date(2026, 1, 27)).report_end == date(2025, 12, 27)
    assert periods.report_anchor(date(2026, 1, 28)).report_end == date(2026, 1, 27)
    anchor = periods.report_anchor(date(2026, 5, 10))
    assert anchor.report_end == date(2026, 4, 27)
    assert (anchor.cohort_start, anchor.cohort_end) == ((2025, 4), (2026, 4))


def test_published_windows_have_28_days():
    assert len(periods.check_windows(periods.PUBLISHED_BENCHMARK_WINDOWS)) == 9
    with pytest.raises(ValueError, match="27 days"):
        periods.check_windows({2030: (date(2030, 1, 6), date(2030, 2, 1))})
    with pytest.raises(ValueError, match="overlap"):
        periods.check_windows({1: (date(2030, 1, 6), date(2030, 2, 2)), 2: (date(2030, 2, 2), date(2030, 3, 1))})


def test_event_dates_follow_the_two_week_guard():
    scope = periods.EventScope(date(2026, 6, 14), date(2026, 7, 19))
    found = periods.event_dates(scope, date(2026, 5, 26))
    assert (found.safe_end, found.pre_start) == (date(2026, 5, 17), date(2026, 4, 20))
    assert (found.data_start, found.data_end) == (date(2024, 4, 20), date(2026, 5, 17))
    assert not found.has_during and not found.has_post
    later = periods.event_dates(scope, date(2026, 12, 1))
    assert later.data_end == later.post_end == date(2026, 8, 30)
    assert later.has_during and later.has_post


@given(st.dates(date(1990, 1, 1), date(2090, 1, 1)))
def test_reporting_months_partition_the_calendar(day):
    close = periods.month_close(day)
    assert close.day == 27 and periods.month_open(close) <= day <= close
    assert periods.month_close(periods.month_open(close)) == close


def test_anchor_sundays(spark):
    rows = cal.reference_months(spark, (2024, 2025, 2026)).collect()
    found = {(r.yr, r.mo): r.reference_sunday for r in rows}
    days = {
        2024: (7, 11, 10, 7, 12, 9, 7, 11, 8, 6, 10, 8),
        2025: (12, 9, 9, 6, 11, 8, 6, 10, 7, 12, 9, 7),
        2026: (11, 8, 8, 12, 10, 7, 12, 9, 6, 11, 8, 6),
    }
    assert found == {(y, m + 1): date(y, m + 1, d) for y, row in days.items() for m, d in enumerate(row)}


def test_columns_agree_with_python_dates(spark):
    first = date(2019, 12, 1)
    days = cal.day_spine(spark, first, first + timedelta(days=2500))
    rows = days.select(
        "event_date",
        cal.week_start("event_date").alias("sun"),
        cal.week_start("event_date", "monday").alias("mon"),
        cal.month_close("event_date").alias("close"),
        cal.weekday_code("event_date").alias("code"),
        cal.iso_year("event_date").alias("iy"),
        cal.iso_week("event_date").alias("iw"),
    ).collect()
    for r in rows:
        d = r.event_date
        assert r.sun == periods.week_floor(d) and r.mon == periods.week_floor(d, "monday")
        assert r.close == periods.month_close(d) and r.code == (d.weekday() + 1) % 7
        assert (r.iy, r.iw) == d.isocalendar()[:2]


def test_weekly_spine_holds_complete_weeks_only(spark):
    rows = cal.weekly_spine(spark, date(2026, 5, 22), 10).orderBy("period_start").collect()
    assert rows[0].period_start == date(2026, 3, 8) and rows[-1].period_end == date(2026, 5, 16)
    assert (rows[0].future_start - rows[0].period_end).days == 1 and len(rows) == 10
    assert cal.weekly_spine(spark, date(2026, 5, 23), 10).count() == 11


def test_date_grid_needs_no_join(spark):
    keys = spark.range(3).withColumnRenamed("id", "location_id")
    grid = cal.dates_per_key(keys, date(2026, 1, 1), date(2026, 1, 5))
    assert grid.count() == 15
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()


def test_unknown_week_start_is_refused():
    with pytest.raises(ValueError):
        cal.week_start(F.lit(date(2026, 1, 1)), "friday")
