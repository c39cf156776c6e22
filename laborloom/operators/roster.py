"""Hiring, turnover and shifts worked at qualifying locations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import month_close, trailing_year_open
from laborloom.functions.labels import SYSTEM_ACTORS, in_us, system_actor
from laborloom.functions.ratios import change_ratio, half_up, pct_over, rounded_ratio
from laborloom.periods import month_close as close_of
from laborloom.periods import month_open
from laborloom.sources.scan import between_dates

REQUIRED_LABELS = ("msa", "naics_code", "business_type_new", "business_category_new")

# Fixed value: the turnover series starts after this closing date.
TURNOVER_HORIZON = date(2018, 12, 1)


def location_info(companies: DataFrame, locations: DataFrame, as_of: date) -> DataFrame:
    """US locations with complete labels of companies over a year old."""
    mature = companies.filter(F.col("created_at") < F.lit(as_of - timedelta(days=365))).select(
        "company_id", F.col("created_at").alias("company_created_date")
    )
    labelled = locations.filter(in_us("state_cleaned")).dropna(subset=list(REQUIRED_LABELS))
    return labelled.join(mature, "company_id").select(
        "location_id",
        "company_id",
        "company_created_date",
        F.col("created_at").alias("location_created_date"),
        "naics_code",
        "msa",
        F.col("state_cleaned").alias("state"),
        F.col("business_type_new").alias("business_type"),
        F.col("business_category_new").alias("business_category"),
    )


def _monthly(rows: DataFrame, info: DataFrame, column: str, first_close: date, last_close: date) -> DataFrame:
    """Rows per reporting month at companies that already existed a year before it.

    Counting per (month, location) first keeps the shuffle small and makes the
    location count a plain count.
    """
    within = between_dates(rows, column, month_open(first_close), last_close)
    dated = within.select("location_id", month_close(F.col(column).cast("date")).alias("period_end"))
    places = info.filter(F.col("state") != "Not USA").select("location_id", "company_created_date")
    return (
        dated.groupBy("period_end", "location_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(places, "location_id")
        .filter(F.col("company_created_date") < trailing_year_open("period_end"))
        .groupBy("period_end")
        .agg(F.countDistinct("location_id").alias("ss"), F.sum("n").alias("timeseries_data"))
    )


def hiring(jobs: DataFrame, info: DataFrame, first_close: date, last_close: date) -> DataFrame:
    """Roster rows created per month, as published."""
    return _monthly(jobs, info, "created_at", first_close, last_close)


def hire_dates(jobs: DataFrame) -> DataFrame:
    """First roster row of a worker at a location."""
    return jobs.groupBy("user_id", "location_id").agg(F.min("created_at").alias("created_at"))


def first_hires(jobs: DataFrame, info: DataFrame, first_close: date, last_close: date) -> DataFrame:
    """Workers hired per month: the defined form, one hire per worker and location."""
    return _monthly(hire_dates(jobs), info, "created_at", first_close, last_close)


def audited_archives(jobs: DataFrame, job_versions: DataFrame, dedupe: bool = False) -> DataFrame:
    """Archived jobs that a person archived.

    As published, an archived job counts once per audit row of its archiving
    day whose actor is known and not a system process; jobs without such a row
    drop out. ``dedupe`` counts each job once and keeps jobs without an audit
    row or actor, dropping only those a system process archived.
    """
    gone = jobs.filter(F.col("archived_at").isNotNull()).select("id", "location_id", "archived_at")
    audit = job_versions.select(
        F.col("item_id"), F.col("created_at").cast("date").alias("audit_day"), F.col("whodunnit")
    )
    on = (F.col("id") == F.col("item_id")) & (F.col("archived_at").cast("date") == F.col("audit_day"))
    if dedupe:
        by_system = audit.filter(system_actor("whodunnit"))
        return gone.dropDuplicates(["id"]).join(by_system, on, "left_anti")
    return gone.join(audit.filter(~system_actor("whodunnit")), on).select("id", "location_id", "archived_at", "whodunnit")


def turnover(
    jobs: DataFrame,
    job_versions: DataFrame,
    info: DataFrame,
    first_close: date,
    last_close: date,
    dedupe: bool = False,
    horizon: date | None = TURNOVER_HORIZON,
) -> DataFrame:
    """Archived jobs per month without system archiving."""
    if horizon is not None:
        first_close = max(first_close, close_of(horizon + timedelta(days=1)))
    # The date range goes below the audit join.
    within = between_dates(jobs, "archived_at", month_open(first_close), last_close)
    archived = audited_archives(within, job_versions, dedupe)
    return _monthly(archived, info, "archived_at", first_close, last_close)


def shifts_worked(events: DataFrame, info: DataFrame, first_close: date, last_close: date) -> DataFrame:
    """Timecards per month."""
    clocked = events.filter(F.col("timecard_created_at").isNotNull())
    return _monthly(clocked, info, "timecard_created_at", first_close, last_close)


def per_location(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Normalize by sample size, then change and index to January of the year.

    Normalizing first keeps a growing sample from showing up as growth.
    """
    normalized = series.withColumn("per_loc", rounded_ratio("timeseries_data", "ss", 4))
    year = F.year("period_end")
    january = F.max(F.when(F.month("period_end") == 1, F.col("per_loc"))).over(Window.partitionBy(*by, year))
    order = Window.partitionBy(*by).orderBy("period_end")
    return normalized.select(
        "*",
        half_up(change_ratio("per_loc", F.lag("per_loc").over(order)), 4).alias("mom_pct"),
        pct_over(F.col("per_loc"), january).alias("indexed"),
    )


def yearly_variance(series: DataFrame, limit: float = 0.05) -> DataFrame:
    """Months whose count moved more than ``limit`` against a year before."""
    months = F.year("period_end") * 12 + F.month("period_end")
    earlier = F.max("timeseries_data").over(Window.orderBy(months).rangeBetween(-12, -12))
    change = change_ratio("timeseries_data", earlier)
    return series.select(
        "period_end",
        "timeseries_data",
        earlier.alias("year_before"),
        half_up(change, 4).alias("yoy_change"),
        (F.abs(change) > limit).alias("needs_review"),
    )


def archive_actors(jobs: DataFrame, job_versions: DataFrame, first_close: date, last_close: date) -> DataFrame:
    """Archiving rows per month and actor class, to explain a turnover spike."""
    actor = F.lower("whodunnit")
    label = F.when(actor.isNull(), "unknown")
    for pattern in SYSTEM_ACTORS:
        label = label.when(actor.like(pattern), pattern.strip("%"))
    day = F.col("archived_at").cast("date")
    within = between_dates(jobs, "archived_at", month_open(first_close), last_close)
    gone = within.select("id", day.alias("gone_on"))
    audit = job_versions.select("item_id", F.col("created_at").cast("date").alias("audit_day"), "whodunnit")
    joined = gone.join(audit, (F.col("id") == F.col("item_id")) & (F.col("gone_on") == F.col("audit_day")))
    return joined.groupBy(month_close("gone_on").alias("period_end"), label.otherwise("person").alias("actor")).agg(
        F.count(F.lit(1)).alias("archives")
    )
