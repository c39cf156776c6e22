"""Activity levels indexed to January of the same year."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import anchor_sunday, in_anchor_week, weekday_code
from laborloom.functions.labels import in_us
from laborloom.functions.ratios import half_up, ratio
from laborloom.operators.benchmark import expected_open

JOIN_KEY = ("yr", "location_id", "day_of_week")
INDEXES = {"employees_working_pct": "idx_employees", "hours_worked_pct": "idx_hours", "businesses_open_pct": "idx_open"}
CHANGES = {
    "employees_mom_ppt": "employees_working_pct",
    "hours_mom_ppt": "hours_worked_pct",
    "open_mom_ppt": "businesses_open_pct",
}


def daily_actuals(
    events: DataFrame, start: date | None = None, end: date | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Workers with a clock-in, hours and an open flag per US location and day."""
    scoped = events.filter(in_us("state"))
    if start is not None:
        scoped = scoped.filter(F.col("event_date") >= F.lit(start))
    if end is not None:
        scoped = scoped.filter(F.col("event_date") <= F.lit(end))
    clocked = F.col("has_clock_in") == 1
    zero = F.lit(0).cast("decimal(18,4)")
    return scoped.groupBy("event_date", "location_id", *by).agg(
        F.countDistinct(F.when(clocked, F.col("user_id"))).alias("users_with_clock_in"),
        F.sum(F.when(clocked, F.coalesce("hours_worked", zero)).otherwise(zero)).alias("total_hours_worked"),
        F.max(F.when(clocked, 1).otherwise(0)).alias("is_open"),
    )


def benchmark_levels(benchmarks: DataFrame, presum: bool = False) -> DataFrame:
    """Columns of the benchmark the index joins on.

    A location whose labels changed inside the window has several rows per
    weekday and counts once per row, as published. ``presum`` adds them up
    first so that every location-weekday joins once.
    """
    levels = benchmarks.select(
        *JOIN_KEY,
        F.col("users_with_clock_in").alias("bench_users"),
        F.col("total_hours_worked").alias("bench_hours"),
        expected_open().alias("bench_open"),
    )
    if not presum:
        return levels
    sums = [F.sum(name).alias(name) for name in ("bench_users", "bench_hours", "bench_open")]
    return levels.groupBy(*JOIN_KEY).agg(*sums)


def daily_index(
    actuals: DataFrame,
    benchmarks: DataFrame,
    by: Sequence[str] = (),
    presum: bool = False,
    min_locations: int | None = None,
) -> DataFrame:
    """Sum of actuals over sum of benchmark, minus one, per day.

    Locations without a benchmark drop out. ``min_locations`` suppresses days
    (or day and ``by`` groups) with fewer contributing locations.
    """
    keyed = actuals.withColumn("yr", F.year("event_date")).withColumn("day_of_week", weekday_code("event_date"))
    joined = keyed.join(benchmark_levels(benchmarks, presum), list(JOIN_KEY))

    def level(actual: str, expected: str) -> Column:
        return ratio(F.sum(actual), F.sum(expected)) - 1

    measures = [
        level("users_with_clock_in", "bench_users").alias("idx_employees"),
        level("total_hours_worked", "bench_hours").alias("idx_hours"),
        level("is_open", "bench_open").alias("idx_open"),
    ]
    if min_locations is not None:
        measures.append(F.countDistinct("location_id").alias("locations"))
    index = joined.groupBy("event_date", "yr", *by).agg(*measures)
    return index if min_locations is None else index.filter(F.col("locations") >= min_locations)


def monthly_index(index: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the seven anchor-week days, in percent, with the change in points.

    The change restarts each January, whose value is NULL.
    """
    year, month = F.col("year"), F.col("month")
    monthly = (
        index.filter(in_anchor_week("event_date"))
        .groupBy(F.col("yr").alias("year"), F.month("event_date").alias("month"), *by)
        .agg(*[half_up(F.avg(source) * 100, 2).alias(name) for name, source in INDEXES.items()])
    )
    order = Window.partitionBy(*by, "year").orderBy("month")
    changes = [
        half_up(F.col(source) - F.lag(source).over(order), 2).alias(name) for name, source in CHANGES.items()
    ]
    return monthly.select(
        *by,
        year,
        month,
        anchor_sunday(year, month).cast("string").alias("reference_sunday"),
        *INDEXES,
        *changes,
    )


def labor_index(
    events: DataFrame,
    benchmarks: DataFrame,
    start: date,
    end: date,
    by: Sequence[str] = (),
    presum: bool = False,
    min_locations: int | None = None,
) -> DataFrame:
    """Monthly index straight from events.

    Only anchor-week days enter the monthly value, so the other three quarters
    of the days are dropped before any aggregation. The test depends on the
    date alone and prunes date partitions.
    """
    anchored = events.filter(in_anchor_week("event_date"))
    actuals = daily_actuals(anchored, start, end, by)
    years = benchmarks.filter(F.col("yr").between(start.year, end.year))
    return monthly_index(daily_index(actuals, years, by, presum, min_locations), by)


def with_region(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Attach the caller's state-to-region lookup; states outside it are 'Other'. Of two regions the smaller counts."""
    lookup = regions.groupBy("state").agg(F.min("region").alias("region"))
    labelled = events.drop("region").join(lookup, "state", "left")
    return labelled.withColumn("region", F.coalesce("region", F.lit("Other")))


def year_overlay(monthly: DataFrame, metric: str, years: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per month (and segment ``by``), one column per year."""
    return monthly.groupBy(*by, "month").pivot("year", list(years)).agg(F.first(metric))


def large_moves(monthly: DataFrame, points: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Month-on-month movements to review, one row per metric (and segment ``by``)."""
    names = list(CHANGES)
    long = monthly.unpivot([*by, "year", "month"], names, "metric", "change_ppt")
    return long.filter(F.abs("change_ppt") > points)
