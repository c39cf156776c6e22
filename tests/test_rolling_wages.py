"""The rolling matched cohort against today's cohort and against plain sums."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalog.common import ANCHOR
from catalog.wage_queries import START, _cuts, _rolling
from laborloom.operators import wages

SF_DIR = "/root/testdata/sf0.01"  # the smaller table has no group above the publishing limit


def test_last_month_equals_the_anchored_series(spark):
    last = F.col("period_end") == F.lit(ANCHOR.report_end)
    rolling = {(r["segmented_by"], r["segment"]): r for r in _rolling(spark, SF_DIR).filter(last).collect()}
    anchored = wages.year_on_year(_cuts(spark, SF_DIR), ["segmented_by", "segment"]).filter(last).collect()
    assert anchored and len(rolling) == len(anchored)
    for r in anchored:
        ours = rolling[r["segmented_by"], r["segment"]]
        assert ours["sample_size_jobs"] == r["sample_size_jobs"]
        assert ours["wage_rate"] == pytest.approx(r["wage_rate"])
        assert (ours["yoy_pct_change"] is None) == (r["yoy_pct_change"] is None)
        assert ours["yoy_pct_change"] == pytest.approx(r["yoy_pct_change"])


def test_each_month_has_its_own_locations(spark):
    """Location 1 pays in all months, 2 stops after June 2001, 3 starts in July 2000; null and repeated runs change nothing."""
    months = [(y, m) for y in (2000, 2001) for m in range(1, 13)]
    pays = {1: months, 2: [x for x in months if x <= (2001, 6)], 3: [x for x in months if x >= (2000, 7)]}
    runs = [(loc, date(y, m, 5)) for loc, ms in pays.items() for y, m in ms] + [(1, date(2001, 1, 9)), (1, None), (None, date(2001, 1, 9))]
    cohort = wages.rolling_cohort(spark.createDataFrame(runs, "location_id long, payday date"))
    members = {r["location_id"]: [(m - 1) // 12 * 100 + (m - 1) % 12 + 1 for m in r["months"]] for r in cohort.collect()}
    assert members == {1: [200100 + m for m in range(1, 13)], 2: [200100 + m for m in range(1, 7)], 3: [200100 + m for m in range(7, 13)]}

    # Each location's one job earns its number of dollars an hour, a tenth more in 2001.
    events = []
    for loc in (1, 2, 3):
        for y, m in months:
            hours, rate = Decimal(10), Decimal(loc) * (Decimal("1.1") if y == 2001 else 1)
            events.append((loc, datetime(y, m, 10), loc * 100, hours * rate, hours))
    schema = "location_id long, timecard_created_at timestamp_ntz, job_id long, total_wages_earned decimal(18,4), hours_worked decimal(18,4)"
    labelled = cohort.withColumn("segments", F.array().cast("array<struct<segmented_by:string,segment:string>>"))
    pay = wages.rolling_pay(spark.createDataFrame(events, schema), labelled, START, date(2001, 12, 27))
    found = {r["period_end"]: r for r in wages.rolling_wages(pay, min_jobs=None).collect()}
    assert sorted(found) == [date(2001, m, 27) for m in range(1, 13)]
    for month, r in found.items():
        there = (1, 2) if month.month <= 6 else (1, 3)
        assert r["sample_size_jobs"] == 2
        assert r["wage_rate"] == pytest.approx(sum(there) / 2 * 1.1)
        assert r["wage_rate_year_ago"] == pytest.approx(sum(there) / 2)
        assert r["yoy_pct_change"] == pytest.approx(0.1)
    assert wages.rolling_wages(pay, min_jobs=2).count() == 0
