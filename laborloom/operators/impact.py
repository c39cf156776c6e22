"""Event impact: weekly metrics, seasonality-free deltas and Welch's test."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import iso_week, iso_year, week_start
from laborloom.functions.labels import inline_qualified
from laborloom.functions.ratios import half_up, ratio, rounded_ratio
from laborloom.functions.student_t import two_sided_p
from laborloom.periods import EventDates, EventScope

METRICS = ("businesses_open", "emp_per_loc", "hrs_per_loc")
BASELINE, BEFORE, DURING, AFTER = "baseline", "pre-event", "during", "post-event"


def in_scope(timeclock: DataFrame, scope: EventScope) -> DataFrame:
    """Exact geography filter; the city is compared in upper case."""
    if scope.state is not None:
        timeclock = timeclock.filter(F.col("state") == scope.state)
    if scope.msa is not None:
        timeclock = timeclock.filter(F.col("msa") == scope.msa)
    if scope.city is not None:
        timeclock = timeclock.filter(F.upper("city") == scope.city.upper())
    return timeclock


def discover_cities(timeclock: DataFrame, name: str, as_of: date, state: str | None = None, days: int = 90) -> DataFrame:
    """Spellings of a city among recent rows of open locations."""
    recent = timeclock.filter(
        (F.col("event_date") >= F.date_sub(F.lit(as_of), days))
        & F.col("loc_archived_at").isNull()
        & F.col("city").ilike(f"%{name}%")
    )
    if state is not None:
        recent = recent.filter(F.col("state") == state)
    # Both counts are over location attributes, so one row per location is enough.
    places = recent.select(F.upper("city").alias("city_upper"), "state", "location_id", "company_id").distinct()
    return places.groupBy("city_upper", "state").agg(
        F.countDistinct("location_id").alias("locations"), F.countDistinct("company_id").alias("companies")
    )


def weekly_metrics(timeclock: DataFrame, scope: EventScope, dates: EventDates, literal: bool = False) -> DataFrame:
    """Open and active locations, workers and hours per week of the scope.

    Weeks start on Monday and carry their ISO year. ``literal`` uses the
    calendar year instead, which splits the week around New Year.
    """
    rows = in_scope(timeclock, scope).filter(
        F.col("event_date").between(F.lit(dates.data_start), F.lit(dates.data_end)) & inline_qualified()
    )
    year = F.year("event_date") if literal else iso_year("event_date")
    keys = ("yr", "week_start", "iso_week")
    clocked = F.col("has_clock_in") == 1
    # One row per week, location and worker first: the distinct counts below
    # then expand this much smaller set.
    small = rows.groupBy(
        year.cast("int").alias("yr"),
        week_start("event_date", "monday").alias("week_start"),
        iso_week("event_date").alias("iso_week"),
        "location_id",
        "user_id",
    ).agg(F.max(F.when(clocked, 1).otherwise(0)).alias("clocked"), F.sum("hours_worked").alias("hours"))
    seen = F.col("clocked") == 1
    return (
        small.groupBy(*keys)
        .agg(
            F.countDistinct(F.when(seen, F.col("location_id"))).alias("businesses_open"),
            F.countDistinct("location_id").alias("active_locs"),
            F.countDistinct(F.when(seen, F.col("user_id"))).alias("employees_working"),
            half_up(F.coalesce(F.sum("hours").cast("double"), F.lit(0.0)), 2).alias("hours_worked"),
        )
        .select(
            "*",
            rounded_ratio("employees_working", "active_locs", 3).alias("emp_per_loc"),
            rounded_ratio("hours_worked", "active_locs", 3).alias("hrs_per_loc"),
            (F.col("active_locs") < scope.min_locations).alias("thin_sample"),
        )
    )


def period_label(scope: EventScope, dates: EventDates) -> Column:
    """Label a week by its first day.

    With a start but no end, everything from ``pre_start`` to ``safe_end`` is
    pre-event, including weeks after the start.
    """
    week = F.col("week_start")
    if scope.event_start and scope.event_end:
        return (
            F.when((week >= F.lit(dates.pre_start)) & (week < F.lit(scope.event_start)), BEFORE)
            .when(week.between(F.lit(scope.event_start), F.lit(scope.event_end)), DURING)
            .when((week > F.lit(scope.event_end)) & (week <= F.lit(dates.post_end)), AFTER)
            .otherwise(BASELINE)
        )
    if scope.event_start:
        return F.when(week.between(F.lit(dates.pre_start), F.lit(dates.safe_end)), BEFORE).otherwise(BASELINE)
    return F.lit(BASELINE)


def yearly_deltas(weekly: DataFrame, scope: EventScope, dates: EventDates, suppress: bool = False) -> DataFrame:
    """Latest year against the year before, per ISO week, in long form.

    A one-year range frame stands in for a self join, so the events behind
    ``weekly`` are read once. Its list has one entry per prior-year row of the
    ISO week: normally one, two where calendar years split a week.
    """
    if suppress:
        weekly = weekly.filter(~F.col("thin_sample"))
    doubles = [F.col(name).cast("double").alias(name) for name in METRICS]
    keep = ["yr", "iso_week", "week_start"]
    long = weekly.select(*keep, *doubles).unpivot(keep, list(METRICS), "metric", "current_value")
    year_before = Window.partitionBy("metric", "iso_week").orderBy("yr").rangeBetween(-1, -1)
    priors = F.collect_list(F.struct(F.col("current_value").alias("prior_value"))).over(year_before)
    paired = (
        long.withColumn("priors", priors)
        .withColumn("latest", F.max("yr").over(Window.partitionBy("metric")))
        .filter(F.col("yr") == F.col("latest"))
        .select("metric", "iso_week", "week_start", "current_value", F.inline("priors"))
    )
    delta = F.col("current_value") - F.col("prior_value")
    return paired.select(
        "metric",
        "iso_week",
        "week_start",
        period_label(scope, dates).alias("period"),
        "current_value",
        "prior_value",
        delta.alias("yoy_delta"),
        (ratio(delta, F.abs("prior_value")) * 100).alias("yoy_pct"),
    )


def period_summary(deltas: DataFrame) -> DataFrame:
    """Mean, spread and size of the deltas per metric and period."""
    spread = F.stddev_samp("yoy_delta")
    return deltas.groupBy("metric", "period").agg(
        F.avg("yoy_delta").alias("mean_delta"),
        spread.alias("sd_delta"),
        (spread / F.sqrt(F.count("yoy_delta"))).alias("se_delta"),
        F.count("yoy_delta").alias("weeks"),
    )


def significance(deltas: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """Welch's unequal-variance test of each event period against baseline.

    Needs two weeks on both sides, otherwise the pair is left out. With no
    variance at all the statistic is undefined and p is NULL.
    """
    stats = deltas.groupBy("metric", "period").agg(
        F.count("yoy_delta").alias("n"), F.avg("yoy_delta").alias("mean"), F.var_samp("yoy_delta").alias("var")
    )
    base = F.col("period") == BASELINE
    over = Window.partitionBy("metric")

    def of_baseline(name: str) -> Column:
        return F.max(F.when(base, F.col(name))).over(over)

    paired = stats.select(
        "*", of_baseline("n").alias("base_n"), of_baseline("mean").alias("base_mean"), of_baseline("var").alias("base_var")
    ).filter(~base & (F.col("n") >= 2) & (F.col("base_n") >= 2))
    se, base_se = F.col("var") / F.col("n"), F.col("base_var") / F.col("base_n")
    pooled = F.nullif(se + base_se, F.lit(0.0))
    df = pooled * pooled / (se * se / (F.col("n") - 1) + base_se * base_se / (F.col("base_n") - 1))
    diff = F.col("mean") - F.col("base_mean")
    tested = paired.select(
        "metric",
        "period",
        F.col("n").alias("weeks"),
        F.col("mean").alias("avg_delta"),
        diff.alias("diff"),
        F.when(diff > 0, "up").otherwise("down").alias("direction"),
        (diff / F.sqrt(pooled)).alias("t_stat"),
        df.alias("df"),
    )
    p = two_sided_p(F.col("t_stat"), F.col("df"))
    return tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") < p_threshold)


def check_weeks(weekly: DataFrame, scope: EventScope) -> DataFrame:
    """Input checks as data: one row per check with what was found.

    The scope needs rows, two years and weeks both years share.
    """
    per_week = weekly.groupBy("iso_week").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("yr").alias("years"))
    return per_week.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("week_rows"),
        F.coalesce(F.max("years"), F.lit(0)).alias("years_sharing_a_week"),
        F.count(F.when(F.col("years") > 1, 1)).alias("shared_weeks"),
    ).select(
        F.lit(scope.city).alias("city"),
        "*",
        F.when(F.col("week_rows") == 0, "no rows in scope")
        .when(F.col("years_sharing_a_week") < 2, "no overlapping weeks in two years")
        .otherwise("ok")
        .alias("verdict"),
    )


def require_city(cities: DataFrame, name: str) -> DataFrame:
    """Raise when city discovery found no spelling at all."""
    if cities.isEmpty():
        raise ValueError(f"no city matches {name!r} among recent rows of open locations; try a shorter part of the name")
    return cities


def require_weeks(weekly: DataFrame, scope: EventScope) -> DataFrame:
    """Raise when the checks fail; runs the (small) weekly aggregate."""
    found = check_weeks(weekly, scope).first()
    if found["verdict"] != "ok":
        raise ValueError(f"event scope {scope.city or scope.state}: {found['verdict']}")
    return weekly
