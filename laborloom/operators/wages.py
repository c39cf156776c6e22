"""Matched-cohort hourly wages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import month_close
from laborloom.functions.labels import in_us
from laborloom.functions.ratios import change_ratio, pct_over, ratio
from laborloom.operators.skew import spread_join
from laborloom.periods import MONTH_CLOSE_DAY, ReportAnchor, month_bounds
from laborloom.sources.scan import between_dates

MIN_JOBS = 20

# Segment name -> location column, with the canonical industry; the legacy one by name.
SEGMENTS = {"industry": "business_type_new", "state": "state_cleaned", "msa": "msa"}
LEGACY_SEGMENTS = {**SEGMENTS, "industry": "business_type"}


def _in_month(column: Column, year: int, month: int) -> Column:
    first, following = month_bounds(year, month)
    return (column >= F.lit(first)) & (column < F.lit(following))


def payroll_cohort(payroll_runs: DataFrame, anchor: ReportAnchor) -> DataFrame:
    """Locations that ran payroll in both cohort months.

    One scan of two month ranges instead of two lookups; partial aggregation
    leaves one row per location before the shuffle.
    """
    start = _in_month(F.col("payday"), *anchor.cohort_start)
    end = _in_month(F.col("payday"), *anchor.cohort_end)
    return (
        payroll_runs.filter(start | end)
        .groupBy("location_id")
        .agg(F.max(start).alias("ran_start"), F.max(end).alias("ran_end"))
        .filter(F.col("ran_start") & F.col("ran_end"))
        .select("location_id")
    )


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def rolling_cohort(payroll_runs: DataFrame) -> DataFrame:
    """Report months (year * 12 + month) for which a location is in the matched cohort, as an array.

    A location belongs to the cohort of a month if it ran payroll in it and in the same month a year before: a range
    frame 12 months back over its months. One row per location, with at most one entry for each month.
    """
    ran = payroll_runs.select("location_id", _month_number(F.col("payday")).alias("month")).distinct()
    back = Window.partitionBy("location_id").orderBy("month").rangeBetween(-12, -12)
    matched = ran.withColumn("year_ago", F.count(F.lit(1)).over(back)).filter("year_ago > 0")
    return matched.groupBy("location_id").agg(F.sort_array(F.collect_list("month")).alias("months"))


def rolling_pay(events: DataFrame, cohort: DataFrame, start: date, end: date) -> DataFrame:
    """Job pay by report month, once as this year's and once as last year's side of the comparison.

    ``cohort`` is :func:`rolling_cohort`, with or without :func:`with_segments`. A job's month of pay counts for the
    cohort of that month (``side`` "now") and for the cohort of the month a year later ("year_ago"), whichever the
    location belongs to; ``period_end`` names the report month.
    """
    pay = job_pay(events, cohort, start, end)
    month = _month_number(F.col("period_end"))
    sides = F.array(
        F.struct(month.alias("report"), F.lit("now").alias("side")), F.struct((month + 12).alias("report"), F.lit("year_ago").alias("side"))
    )
    last = end.year * 12 + end.month
    told = F.filter(sides, lambda s: F.array_contains("months", s["report"]) & (s["report"] <= last))
    rows = pay.withColumn("told", F.explode(told))
    report = F.col("told.report") - 1
    close = F.make_date(F.floor(report / 12).cast("int"), (report % 12 + 1).cast("int"), F.lit(MONTH_CLOSE_DAY))
    return rows.withColumns({"period_end": close, "side": F.col("told.side")}).drop("told", "months")


def rolling_wages(pay: DataFrame, min_jobs: int | None = MIN_JOBS) -> DataFrame:
    """Wage rate and growth against the year before, each month within its own matched cohort.

    Unlike :func:`year_on_year` on one cohort's series, both rates of a row come from the locations that ran payroll in
    that month and a year before. Groups too thin this year are left out, those too thin a year ago have no growth.
    """
    cuts = wage_cuts(pay, min_jobs=min_jobs, keys=("period_end", "side"))
    now = F.col("side") == "now"
    both = cuts.groupBy("segmented_by", "segment", "period_end").agg(
        F.max(F.when(now, F.col("wage_rate"))).alias("wage_rate"),
        F.max(F.when(now, F.col("sample_size_jobs"))).alias("sample_size_jobs"),
        F.max(F.when(~now, F.col("wage_rate"))).alias("wage_rate_year_ago"),
    )
    shown = both.filter(F.col("sample_size_jobs").isNotNull())
    return shown.withColumn("yoy_pct_change", change_ratio("wage_rate", F.col("wage_rate_year_ago")))


def job_pay(events: DataFrame, cohort: DataFrame, start: date, end: date) -> DataFrame:
    """Wages and hours of the cohort per location, reporting month and job.

    Bounds go on the raw clock-in column so the scan prunes, and the reporting
    month is a function of the date rather than a join to a month list. Events
    of other locations leave before the aggregate shuffles them: the cohort's
    ids go to all tasks where Spark measures them as small, else the semi join
    splits large locations. Further columns of ``cohort`` (one row per
    location) join the totals, split by job.
    """
    scoped = between_dates(events.filter(F.col("timecard_created_at").isNotNull()), "timecard_created_at", start, end)
    pay = scoped.select("location_id", "timecard_created_at", "job_id", "total_wages_earned", "hours_worked")
    pay = pay.join(cohort.select("location_id"), "location_id", "left_semi")
    totals = pay.groupBy(
        "location_id", month_close(F.col("timecard_created_at").cast("date")).alias("period_end"), "job_id"
    ).agg(F.sum("total_wages_earned").alias("wages"), F.sum("hours_worked").alias("hours"))
    return totals if cohort.columns == ["location_id"] else labelled_pay(totals, cohort)


def labelled_pay(pay: DataFrame, cohort: DataFrame) -> DataFrame:
    """Job pay with the further columns of ``cohort`` (one row per location), split by job."""
    return spread_join(pay, cohort, "location_id", "job_id")


def with_segments(cohort: DataFrame, locations: DataFrame, segments: dict[str, str] = SEGMENTS) -> DataFrame:
    """Cohort locations with their segment labels; NULL outside the US.

    Both sides have one row per location, so labelling here is cheaper than
    labelling the pay rows.
    """
    return cohort.join(_segments(locations, segments), "location_id", "left")


def _segments(locations: DataFrame, segments: dict[str, str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(name).alias("segmented_by"), F.col(column).alias("segment"))
        for name, column in segments.items()
    ]
    return locations.filter(in_us("state")).select("location_id", F.array(*pairs).alias("segments"))


def wage_cuts(
    pay: DataFrame,
    locations: DataFrame | None = None,
    segments: dict[str, str] | None = None,
    min_jobs: int | None = MIN_JOBS,
    keys: Sequence[str] = ("period_end",),
) -> DataFrame:
    """National wages and every segment cut from one pass over job pay, for each combination of ``keys``.

    ``pay`` may already carry labels from :func:`with_segments`; otherwise they
    come from ``locations``, as ``segments`` (default SEGMENTS) names them.

    A job's rate is its wages over its hours; a cut is the plain mean over
    jobs. The national cut pools a job's locations and needs no location row,
    the others keep the job per location and follow the US filter. Groups with
    ``min_jobs`` jobs or fewer are suppressed.
    """
    national = F.struct(F.lit("national").alias("segmented_by"), F.lit("national").alias("segment"))
    labelled = pay
    if "segments" not in pay.columns:
        labelled = spread_join(pay, _segments(locations, segments or SEGMENTS), "location_id", "job_id", "left")
    elif locations is not None or segments is not None:
        raise ValueError("pay carries its segment labels already; locations and segments would be ignored")
    every_cut = F.concat(F.array(national), F.coalesce("segments", F.array().cast("array<struct<segmented_by:string,segment:string>>")))
    rows = labelled.select("location_id", *keys, "job_id", "wages", "hours", F.explode(every_cut).alias("cut"))
    cut = F.col("cut.segmented_by")
    rates = (
        rows.groupBy(
            cut.alias("segmented_by"),
            F.col("cut.segment").alias("segment"),
            *keys,
            F.when(cut != "national", F.col("location_id")).alias("place"),
            "job_id",
        )
        .agg(F.sum("wages").alias("wages"), F.sum("hours").alias("hours"))
        .withColumn("rate", ratio("wages", "hours"))
    )
    return _mean_of_rates(rates, ("segmented_by", "segment", *keys), min_jobs)


def wage_rates(
    pay: DataFrame, locations: DataFrame | None = None, by: str | None = None, min_jobs: int | None = MIN_JOBS
) -> DataFrame:
    """One wage cut: national, or by one location column."""
    if by is None:
        keys: tuple = ("period_end",)
        totals = pay.groupBy("period_end", "job_id").agg(F.sum("wages").alias("wages"), F.sum("hours").alias("hours"))
    else:
        keys = (by, "period_end")
        places = locations.filter(in_us("state")).select("location_id", by)
        totals = spread_join(pay, places, "location_id", "job_id")
    return _mean_of_rates(totals.withColumn("rate", ratio("wages", "hours")), keys, min_jobs)


def _mean_of_rates(rates: DataFrame, keys: Sequence[str], min_jobs: int | None) -> DataFrame:
    cuts = rates.groupBy(*keys).agg(
        F.avg("rate").alias("wage_rate"), F.countDistinct("job_id").alias("sample_size_jobs")
    )
    return cuts if min_jobs is None else cuts.filter(F.col("sample_size_jobs") > min_jobs)


def against_base(wages: DataFrame, year: int, month: int, by: Sequence[str] = ()) -> DataFrame:
    """Percent above the rate of the base month, derived from the series itself."""
    is_base = (F.year("period_end") == year) & (F.month("period_end") == month)
    whole = Window.partitionBy(*by)
    base = F.max(F.when(is_base, F.col("wage_rate"))).over(whole)
    return wages.withColumn("pct_above_base", pct_over(F.col("wage_rate"), base))


def month_on_month(wages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rate over the previous listed month's rate, minus one."""
    order = Window.partitionBy(*by).orderBy("period_end")
    return wages.withColumn("mom_pct_change", change_ratio("wage_rate", F.lag("wage_rate").over(order)))


def year_on_year(wages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wage growth against the same month a year before.

    The closing day is always the 27th, so the month number difference finds
    the earlier row with a range frame.
    """
    months = F.year("period_end") * 12 + F.month("period_end")
    order = Window.partitionBy(*by).orderBy(months).rangeBetween(-12, -12)
    return wages.withColumn("yoy_pct_change", change_ratio("wage_rate", F.max("wage_rate").over(order)))
