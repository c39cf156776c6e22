"""Hand-sized edge cases."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from laborloom.functions import labels, ratios
from laborloom.functions.student_t import two_sided_p
from laborloom.operators import base, benchmark, classify, impact, index, quality, roster, wages
from laborloom.periods import EventScope, ReportAnchor, event_dates
from laborloom.schemas import LOCATIONS, require
from laborloom.sources import scan, sinks
from tests.conftest import SF_DIR

WINDOW = {2026: (date(2026, 1, 4), date(2026, 1, 31))}


def events(spark, rows):
    """(location, day, user, clock-in, hours, city) -> minimal shift events."""
    data = [
        (loc, day, user, i, clock, 0, str(hours), "5.0", "TX", "m", "i", city)
        for i, (loc, day, user, clock, hours, city) in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data,
        "location_id long, event_date date, user_id long, shift_id long, has_clock_in int, unscheduled int, "
        "hours string, planned string, state string, msa string, industry string, city string",
    )
    return df.select(
        "*",
        F.when(F.col("has_clock_in") == 1, F.col("hours").cast("decimal(18,4)")).alias("hours_worked"),
        F.col("planned").cast("decimal(18,4)").alias("hours_scheduled"),
    )


def test_full_window_indexes_to_zero(spark):
    days = [date(2026, 1, 4) + timedelta(days=i) for i in range(28)]
    rows = [(loc, day, user, 1, 4, "x") for loc in (1, 2) for day in days for user in (10, 11)]
    ev = events(spark, rows)
    daily = index.daily_index(index.daily_actuals(ev), benchmark.weekday_benchmark(ev, WINDOW)).collect()
    assert len(daily) == 28
    assert all(abs(r.idx_employees) < 1e-12 and abs(r.idx_hours) < 1e-12 and abs(r.idx_open) < 1e-12 for r in daily)


def test_weekday_without_clock_in_has_null_level(spark):
    ev = events(spark, [(1, date(2026, 1, 5), 1, 0, 0, "x"), (1, date(2026, 1, 6), 1, 1, 3, "x")])
    rows = {r.day_of_week: r for r in benchmark.weekday_benchmark(ev, WINDOW).collect()}
    assert rows[1].denominator_clock_ins is None and rows[1].users_with_clock_in is None
    assert rows[1].total_scheduled_shifts == 1.0
    assert rows[2].users_with_clock_in == 1.0 and rows[2].total_hours_worked == 3.0


def test_label_change_fans_out_unless_presummed(spark):
    rows = [(1, date(2026, 1, 5), 1, 1, 4, "old"), (1, date(2026, 1, 12), 1, 1, 4, "new")]
    ev = events(spark, rows)
    bench = benchmark.weekday_benchmark(ev, WINDOW)
    assert quality.duplicate_benchmark_keys(bench).collect()[0].rows == 2
    actual = index.daily_actuals(ev)
    literal = index.daily_index(actual, bench).first()
    summed = index.daily_index(actual, bench, presum=True).first()
    assert literal.idx_employees == 0.0 and summed.idx_employees == -0.5


def test_us_filter_drops_missing_state(spark):
    df = spark.createDataFrame([("TX",), ("Not USA",), ("Unclassified",), (None,)], "state string")
    assert [r.state for r in df.filter(labels.in_us("state")).collect()] == ["TX"]


def test_size_bands(spark):
    counts = [None, 0, 1, 4, 5, 9, 10, 19, 20, 49, 50, 99, 100, 249, 250, 499, 500, 999, 1000]
    df = spark.createDataFrame([(c,) for c in counts], "n int").select("n", labels.size_band("n").alias("band"))
    bands = {r.n: r.band for r in df.collect()}
    assert bands[None] == bands[1000] == "Unknown" and bands[0] == "0 employees"
    assert bands[4] == "1–4 employees" and bands[5] == "5–9 employees" and bands[99] == "50–99 employees"
    assert bands[100] == "100–249 employees" and bands[999] == "500–999 employees"


def test_ratios_guard_zero_and_ties(spark):
    df = spark.createDataFrame([(250.2, 24.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    rows = df.select(ratios.rounded_ratio("a", "b").alias("r"), ratios.ratio("a", "b").alias("q")).collect()
    assert [r.r for r in rows] == [10.43, None, 0.0]
    assert rows[1].q is None and rows[2].q is None


@pytest.mark.parametrize("df, t", [(1, 12.706205), (2, 4.302653), (5, 2.570582), (10, 2.228139), (30, 2.042272), (1000, 1.962339), (1e6, 1.959966)])
def test_student_t_critical_values(spark, df, t):
    p = spark.range(1).select(two_sided_p(F.lit(float(t)), F.lit(float(df))).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=2e-6)


def test_student_t_undefined_is_null(spark):
    missing = F.lit(None).cast("double")
    row = spark.range(1).select(two_sided_p(missing, F.lit(3.0)).alias("a"), two_sided_p(F.lit(0.0), F.lit(1.5)).alias("b")).first()
    assert row.a is None and row.b == pytest.approx(1.0)


def pay(spark, jobs, location=1):
    rows = [(location, date(2026, 1, 27), job, "10.0", "1.0") for job in range(jobs)]
    df = spark.createDataFrame(rows, "location_id long, period_end date, job_id long, w string, h string")
    return df.select("location_id", "period_end", "job_id", F.col("w").cast("decimal(18,4)").alias("wages"), F.col("h").cast("decimal(18,4)").alias("hours"))


def test_wage_suppression_needs_more_than_twenty_jobs(spark):
    assert wages.wage_rates(pay(spark, 20)).count() == 0
    assert wages.wage_rates(pay(spark, 21)).first().sample_size_jobs == 21
    assert wages.wage_rates(pay(spark, 20), min_jobs=None).count() == 1


def test_zero_hours_with_wages_give_null_rate(spark):
    base_pay = pay(spark, 21)
    broken = base_pay.withColumn("hours", F.when(F.col("job_id") > 0, F.col("hours")).otherwise(0).cast("decimal(18,4)"))
    row = wages.wage_rates(broken).first()
    assert row.wage_rate == 10.0 and row.sample_size_jobs == 21


def test_wage_cuts_equal_single_cuts(spark):
    both = pay(spark, 25).unionByName(pay(spark, 30, location=2))
    places = spark.createDataFrame(
        [(1, "TX", "TX", "m1", "food"), (2, "Not USA", "TX", "m2", "retail")],
        "location_id long, state string, state_cleaned string, msa string, business_type string",
    )
    cuts = {(r.segmented_by, r.segment): r.sample_size_jobs for r in wages.wage_cuts(both, places, wages.LEGACY_SEGMENTS).collect()}
    assert cuts == {("national", "national"): 30, ("industry", "food"): 25, ("state", "TX"): 25, ("msa", "m1"): 25}


def test_payroll_cohort_needs_both_months(spark):
    runs = [(1, date(2025, 4, 1)), (1, date(2026, 4, 30)), (2, date(2026, 4, 2)), (3, date(2025, 4, 30)), (3, date(2026, 5, 1))]
    df = spark.createDataFrame(runs, "location_id long, payday date")
    assert [r.location_id for r in wages.payroll_cohort(df, ReportAnchor(date(2026, 4, 27))).collect()] == [1]


def test_base_month_comes_from_the_series(spark):
    rows = [(date(2022, 1, 27), 10.0), (date(2022, 2, 27), 11.0)]
    df = spark.createDataFrame(rows, "period_end date, wage_rate double")
    assert [r.pct_above_base for r in wages.against_base(df, 2022, 1).orderBy("period_end").collect()] == [0.0, 10.0]
    assert {r.pct_above_base for r in wages.against_base(df, 2021, 1).collect()} == {None}


def archive_tables(spark):
    jobs = spark.createDataFrame(
        [(i, 1, 7, date(2026, 1, 1), date(2026, 2, 10)) for i in range(1, 6)],
        "id long, user_id long, location_id long, created_at date, archived_at date",
    )
    audit = spark.createDataFrame(
        [
            (2, date(2026, 2, 10), None),
            (3, date(2026, 2, 10), "user 1"),
            (3, date(2026, 2, 10), "user 2"),
            (4, date(2026, 2, 10), "Rake businesses:archive_invoiced_company[9]"),
            (5, date(2026, 2, 11), "user 3"),
        ],
        "item_id long, created_at date, whodunnit string",
    )
    info = spark.createDataFrame([(7, "TX", date(2020, 1, 1))], "location_id long, state string, company_created_date date")
    return jobs, audit, info


def test_turnover_audit_rules(spark):
    jobs, audit, info = archive_tables(spark)
    span = (date(2026, 2, 27), date(2026, 2, 27))
    # Job 1 has no audit row, 2 no actor, 3 two audit rows, 4 a system actor, 5 another day.
    assert roster.turnover(jobs, audit, info, *span).first().timeseries_data == 2
    assert roster.turnover(jobs, audit, info, *span, dedupe=True).first().timeseries_data == 4
    actors = {r.actor: r.archives for r in roster.archive_actors(jobs, audit, *span).collect()}
    assert actors == {"person": 2, "unknown": 1, "rake businesses:archive_invoiced_company": 1}


def test_turnover_horizon_cuts_early_months(spark):
    jobs, audit, info = archive_tables(spark)
    span = (date(2025, 12, 27), date(2026, 3, 27))
    assert roster.turnover(jobs, audit, info, *span, horizon=date(2026, 2, 27)).count() == 0
    assert roster.turnover(jobs, audit, info, *span, horizon=date(2026, 2, 26)).count() == 1


def test_company_age_is_judged_per_period(spark):
    jobs = spark.createDataFrame([(1, 7, date(2026, 1, 5)), (2, 7, date(2026, 3, 5))], "id long, location_id long, created_at date")
    info = spark.createDataFrame([(7, "TX", date(2025, 2, 10))], "location_id long, state string, company_created_date date")
    rows = roster.hiring(jobs, info, date(2026, 1, 27), date(2026, 3, 27)).collect()
    assert [(r.period_end, r.ss, r.timeseries_data) for r in rows] == [(date(2026, 3, 27), 1, 1)]


def test_january_index_and_change(spark):
    rows = [(date(2026, 1, 27), 2, 5), (date(2026, 2, 27), 2, 6), (date(2027, 2, 27), 2, 6)]
    df = spark.createDataFrame(rows, "period_end date, ss long, timeseries_data long")
    out = roster.per_location(df).orderBy("period_end").collect()
    assert [(r.per_loc, r.mom_pct, r.indexed) for r in out] == [(2.5, None, 0.0), (3.0, 0.2, 20.0), (3.0, 0.0, None)]


def test_naics_rules(spark):
    assert classify.naics_rules(spark).count() == classify.naics_rules(spark).select("naics_code").distinct().count() == 193
    codes = [("722511",), ("492210",), ("713940",), ("999999",), (None,)]
    rows = classify.by_naics(spark.createDataFrame(codes, "naics_code string")).collect()
    found = {r.naics_code: r.broad_industry for r in rows}
    assert found["722511"] == found["492210"] == "Food, Drink, & Dining" and found["713940"] == "Entertainment"
    assert found["999999"] == found[None] == "Other / Unknown"


def test_event_windows_with_one_week_are_skipped(spark):
    scope = EventScope(date(2026, 3, 2), date(2026, 3, 8), pre_weeks=0)
    dates = event_dates(scope, date(2026, 6, 1))
    weeks = []
    for yr in (2025, 2026):
        for week in range(2, 18):
            start = date.fromisocalendar(yr, week, 1)
            level = week + (3 * (week % 2) if yr == 2026 else 0)
            weeks.append((yr, start, week, level, float(level), float(level), False))
    df = spark.createDataFrame(
        weeks,
        "yr int, week_start date, iso_week int, businesses_open long, emp_per_loc double, hrs_per_loc double, thin_sample boolean",
    )
    deltas = impact.yearly_deltas(df, scope, dates)
    assert {r.period for r in deltas.select("period").distinct().collect()} == {"baseline", "during", "post-event"}
    assert {r.period for r in impact.significance(deltas).collect()} == {"post-event"}
    assert impact.check_weeks(df, scope).first().verdict == "ok"
    with pytest.raises(ValueError, match="no overlapping weeks"):
        impact.require_weeks(df.filter("yr = 2026"), scope)
    with pytest.raises(ValueError, match="no rows"):
        impact.require_weeks(df.filter("yr = 1"), scope)


def test_year_boundary_week_keeps_one_iso_year(spark):
    from laborloom.functions.calendar import iso_week, iso_year

    df = spark.createDataFrame([(date(2024, 12, 30),), (date(2025, 1, 2),)], "event_date date")
    rows = df.select(iso_year("event_date").alias("y"), iso_week("event_date").alias("w")).distinct().collect()
    assert [(r.y, r.w) for r in rows] == [(2025, 1)]


def test_engagement_change(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 0), (5, None, 1)]
    df = spark.createDataFrame(rows, "location_id long, engagement_boolean int, engagement_boolean_30d_ago int")
    found = {r.location_id: r.engagement_change for r in base.engagement_change(df).collect()}
    assert found == {1: "newly engaged", 2: "churned", 3: "retained", 4: "inactive", 5: "churned"}


def test_duplicate_lookup_entries_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, raw_state string")
    lookup = spark.createDataFrame([("a", "A"), ("a", "A")], "raw string, label string")
    rows = base.standard_label(df, "raw_state", lookup, "state", "Unclassified").orderBy("id").collect()
    assert [r.state for r in rows] == ["A", "Unclassified"]


def test_sinks_and_scans(spark, tmp_path):
    path = str(tmp_path / "bench")
    df = spark.createDataFrame([(2025, 1, 1.0), (2026, 1, 2.0)], "yr int, location_id long, level double")
    sinks.replace_table(df, path, ["yr"])
    sinks.replace_table(df.filter("yr = 2026").withColumn("level", F.lit(9.0)), path, ["yr"])
    kept = {r.yr: r.level for r in scan.scan(spark, path).collect()}
    assert kept == {2025: 1.0, 2026: 9.0}
    hot = spark.range(2000).select((F.col("id") % 2 + 2025).cast("int").alias("yr"), F.lit(7).alias("location_id"), "id")
    many = tmp_path / "many"
    sinks.replace_table(hot, str(many), ["yr"], files_per_partition=4)
    files = list((many / "yr=2025").glob("*.parquet"))
    assert 1 <= len(files) <= 4 and scan.scan(spark, str(many)).count() == 2000
    plain = str(tmp_path / "plain")
    sinks.replace_table(df, plain)
    assert scan.scan(spark, plain).count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    tagged = scan.union_years({2024: df.drop("yr"), 2025: df.drop("yr")})
    assert tagged.groupBy("yr").count().count() == 2
    scan.register_views({"bench_levels": df})
    assert spark.sql("SELECT max(level) AS m FROM bench_levels").first().m == 2.0


def test_date_bounds_use_the_raw_column(spark, tmp_path):
    path = str(tmp_path / "cards")
    stamps = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-31 23:59:59' AS at UNION ALL SELECT TIMESTAMP_NTZ '2026-02-01 00:00:00'")
    stamps.write.parquet(path)
    df = scan.scan(spark, path, "at", date(2026, 1, 1), date(2026, 1, 31))
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(at" in plan


def test_contract_check_names_missing_columns(spark):
    with pytest.raises(ValueError, match="naics_code"):
        require(spark.range(1).withColumnRenamed("id", "location_id"), LOCATIONS, "locations")


def test_profile_and_gaps(spark):
    df = spark.createDataFrame([(date(2026, 1, 1), 1.0), (date(2026, 1, 3), None)], "event_date date, v double")
    row = quality.column_profile(df, ["v"]).first()
    assert (row.rows, row.nulls, row.null_rate, row.min_value) == (2, 1, 0.5, 1.0)
    missing = quality.missing_days(df, date(2026, 1, 1), date(2026, 1, 4)).orderBy("event_date").collect()
    assert [r.event_date.day for r in missing] == [2, 4]
    fresh = quality.freshness([(df, {"x": "event_date"}), (df.limit(0), {"y": "event_date"})], date(2026, 1, 3))
    assert {r.source: r.fresh for r in fresh.collect()} == {"x": True, "y": False}


def test_monthly_export_and_weekly_publish(spark, tmp_path):
    from catalog.common import AS_OF, WINDOWS
    from catalog.quality_queries import report
    from laborloom.plans.publish import export_monthly, publish_weekly
    from laborloom.sources import star_adapter as sample
    from tests.conftest import SF_DIR

    paths = export_monthly(report(spark, SF_DIR), str(tmp_path), WINDOWS, min_locations=None)
    rows = spark.read.option("header", "true").csv(paths[0])
    assert rows.count() == 34 and "employees_working_pct" in rows.columns
    weekly_path = str(tmp_path / "weekly")
    assert publish_weekly(sample.timeclock(spark, SF_DIR), AS_OF, weekly_path, min_locations=None).count() == 259
    assert publish_weekly(sample.timeclock(spark, SF_DIR), AS_OF, weekly_path).count() == 0


def test_city_discovery_needs_a_match(spark):
    rows = [("ASIA CITY", "TX", 1, 1, date(2026, 5, 1), None)]
    df = spark.createDataFrame(rows, "city string, state string, location_id long, company_id long, event_date date, loc_archived_at date")
    found = impact.discover_cities(df, "asia", date(2026, 6, 1), "TX")
    assert impact.require_city(found, "asia").first().locations == 1
    with pytest.raises(ValueError, match="no city matches"):
        impact.require_city(impact.discover_cities(df, "asia", date(2026, 12, 1)), "asia")


def test_base_builds_meet_their_contracts(spark):
    from catalog.base_tables import _built, _enriched
    from laborloom.schemas import SHIFT_EVENTS, TIMECLOCK
    from tests.conftest import SF_DIR

    require(_built(spark, SF_DIR), SHIFT_EVENTS, "shift events")
    require(_enriched(spark, SF_DIR), TIMECLOCK, "timeclock")


def test_build_drops_open_shifts_and_high_rates(spark):
    shifts = spark.sql(
        "SELECT id, owner, 1L AS owner_id, role AS role_id, TIMESTAMP_NTZ '2026-01-05 08:00:00' AS start_at, "
        "TIMESTAMP_NTZ '2026-01-05 12:30:00' AS end_at, TIMESTAMP_NTZ '2026-01-01 00:00:00' AS created_at, "
        "CAST(NULL AS INT) AS unscheduled FROM VALUES (1L, 'Job', 1L), (2L, 'OpenShift', 1L), (3L, 'Job', 2L), (4L, 'Job', 3L) AS t(id, owner, role)"
    ).withColumnRenamed("owner", "owner_type")
    cards = spark.sql(
        "SELECT 9L AS id, 1L AS shift_id, TIMESTAMP_NTZ '2026-01-05 08:15:00' AS start_at, "
        "TIMESTAMP_NTZ '2026-01-05 12:00:00' AS end_at, TIMESTAMP_NTZ '2026-01-05 08:15:00' AS created_at"
    )
    jobs = spark.createDataFrame([(1, 5, 7)], "id long, user_id long, location_id long")
    places = spark.createDataFrame(
        [(7, 1, "tx", "metro", "food", "Austin", "73301")],
        "location_id long, company_id long, state string, msa string, business_type string, city string, zip string",
    )
    firms = spark.createDataFrame([(1, None)], "company_id long, onboarding_business_description string")
    empty = spark.createDataFrame([], "raw string, label string")
    maps = {"state": spark.createDataFrame([("tx", "Texas")], "raw string, label string"), "msa": empty, "industry": empty, "zip": empty}
    role = spark.sql("SELECT 5L AS user_id, 1L AS role_id, 20.0 AS wage_rate UNION ALL SELECT 5L, 2L, 100.0")
    default = spark.sql("SELECT 5L AS user_id, 15.0 AS wage_rate")
    rows = {r.shift_id: r for r in base.build_shift_events(shifts, jobs, cards, places, firms, maps, role, default).collect()}
    assert set(rows) == {1, 3, 4}
    assert float(rows[1].hours_scheduled) == 4.5 and float(rows[1].hours_worked) == 3.75
    assert float(rows[1].total_wages_earned) == 75.0 and rows[1].has_clock_in == 1 and rows[1].unscheduled == 0
    assert rows[3].hourly_wage_rate is None and rows[3].has_clock_in == 0 and rows[3].hours_worked is None
    assert float(rows[4].hourly_wage_rate) == 15.0
    assert (rows[1].state, rows[1].msa, rows[1].industry, rows[1].county_code) == ("Texas", "All other", "Unknown", None)


def test_spread_join_splits_a_hot_key(spark):
    from laborloom.operators.skew import spread_join

    rows = spark.range(1000).select(F.lit(7).alias("location_id"), F.col("id").alias("job_id"))
    rows = rows.unionByName(spark.range(5).select(F.lit(9).alias("location_id"), F.col("id").alias("job_id")))
    dim = spark.createDataFrame([(7, "a"), (8, "b")], "location_id int, label string")
    assert spread_join(rows, dim, "location_id", "job_id").groupBy("label").count().collect() == [("a", 1000)]
    assert spread_join(rows, dim, "location_id", "job_id", "left").filter("label is null").count() == 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spread_join(rows, dim, "location_id", "job_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(location_id") == 2 and "_part" in plan


def test_hours_ignore_clock_changes_without_a_zone(spark):
    text = "SELECT {0} '2026-03-08 01:30:00' AS a, {0} '2026-03-08 03:30:00' AS b"
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        plain, zoned = spark.sql(text.format("TIMESTAMP_NTZ")), spark.sql(text.format("TIMESTAMP_LTZ"))
        hours = [float(df.select(base.hours_between(df, "a", "b").alias("h")).first().h) for df in (plain, zoned)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert hours == [2.0, 1.0]


def test_month_benchmark_options_and_unknown_names(spark):
    from catalog.quality_queries import report

    monthly = report(spark, SF_DIR)
    assert monthly.labor(benchmark="month", by=["industry"], min_locations=10**6).isEmpty()
    with pytest.raises(ValueError, match="nonsense"):
        monthly.labor(benchmark="nonsense")


def test_labelled_pay_refuses_further_segments(spark):
    pay = spark.createDataFrame([], "location_id long, segments array<struct<segmented_by:string,segment:string>>")
    with pytest.raises(ValueError, match="already"):
        wages.wage_cuts(pay, segments={"state": "state"})


def test_event_report_raises_on_a_bad_scope(spark):
    from laborloom.periods import EventScope
    from laborloom.plans.event_report import EventReport
    from laborloom.sources import star_adapter as sample

    nowhere = EventScope(event_start=date(2001, 6, 4), event_end=date(2001, 7, 8), city="NOWHERE AT ALL")
    report = EventReport(sample.timeclock(spark, SF_DIR), nowhere, sample.AS_OF)
    with pytest.raises(ValueError, match="no rows"):
        report.deltas()
    with pytest.raises(ValueError, match="no city"):
        report.cities()


def test_smallest_of_two_labels(spark):
    lookup = spark.createDataFrame([("a", "second"), ("a", "first")], "raw string, label string")
    rows = spark.createDataFrame([("a",), ("b",)], "x string")
    found = base.standard_label(rows, "x", lookup, "x", "none").collect()
    assert sorted(r["x"] for r in found) == ["first", "none"]
