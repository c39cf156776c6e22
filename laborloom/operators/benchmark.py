"""January reference levels per location and weekday."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import in_windows, week_start, weekday_code, window_year
from laborloom.functions.ratios import ratio
from laborloom.periods import check_windows

LABELS = ("state", "msa", "industry", "city")

# Total column -> denominator column of each daily level.
LEVELS = {
    "users_with_clock_in": "denominator_clock_ins",
    "scheduled_clock_ins": "denominator_clock_ins_and_scheduled_shifts",
    "users_with_scheduled_shifts": "denominator_scheduled_shifts",
    "total_scheduled_shifts": "denominator_scheduled_shifts",
    "total_clock_ins": "denominator_clock_ins",
    "total_hours_scheduled": "denominator_scheduled_shifts",
    "total_hours_worked": "denominator_clock_ins",
}


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def location_days(events: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Activity of each location and day: two flags and seven measures.

    Events move once, by location and day. There each worker and each shift of
    a group is marked at its first row, so the three distinct counts are plain
    sums and no row is expanded; consumers that need only some columns get the
    unused marks pruned away. A very large location spreads over its days.
    """
    clocked, scheduled = F.col("has_clock_in") == 1, F.col("unscheduled") == 0
    zero = F.lit(0).cast("decimal(18,4)")
    keys = ["location_id", *labels, "event_date"]

    def once(name: str, condition: Column) -> Column:
        """1 at the first row of each value that meets the condition in any row of its group."""
        alike = Window.partitionBy(*keys, name)
        first = F.row_number().over(alike.orderBy(name)) == 1
        return F.when(first & F.col(name).isNotNull() & (F.max(F.when(condition, 1)).over(alike) == 1), 1)

    placed = events.repartition("location_id", "event_date")
    marked = placed.select(
        "*",
        once("user_id", clocked).alias("_clocked_user"),
        once("user_id", scheduled).alias("_scheduled_user"),
        once("shift_id", scheduled).alias("_scheduled_shift"),
    )
    return marked.groupBy(*keys).agg(
        F.max("has_clock_in").alias("has_clock_in"),
        _flag(scheduled).alias("has_scheduled_shift"),
        F.count("_clocked_user").alias("users_with_clock_in"),
        F.count(F.when(clocked & scheduled, 1)).alias("scheduled_clock_ins"),
        F.count("_scheduled_user").alias("users_with_scheduled_shifts"),
        F.count("_scheduled_shift").alias("total_scheduled_shifts"),
        F.count(F.when(clocked, 1)).alias("total_clock_ins"),
        F.sum(F.coalesce("hours_scheduled", zero)).alias("total_hours_scheduled"),
        F.sum(F.when(clocked, F.coalesce("hours_worked", zero)).otherwise(zero)).alias("total_hours_worked"),
    )


def weekday_benchmark(events: DataFrame, windows: dict[int, tuple[date, date]], labels: Sequence[str] = LABELS) -> DataFrame:
    """Benchmarks of every year in one pass over the union of the windows.

    Days without the activity are left out of a level's denominator. Location
    days are unique per (location, labels, date), so active days are counted
    with plain sums.
    """
    check_windows(windows)
    days = location_days(events.filter(in_windows("event_date", windows)), labels)
    keyed = days.withColumn("yr", window_year("event_date", windows)).withColumn("day_of_week", weekday_code("event_date"))
    open_day, planned = F.col("has_clock_in") == 1, F.col("has_scheduled_shift") == 1

    def active(condition: Column) -> Column:
        return F.nullif(F.count(F.when(condition, 1)), F.lit(0))

    totals = keyed.groupBy("yr", "location_id", *labels, "day_of_week").agg(
        F.count(F.lit(1)).alias("days_with_data"),
        active(open_day).alias("denominator_clock_ins"),
        active(planned).alias("denominator_scheduled_shifts"),
        active(open_day & planned).alias("denominator_clock_ins_and_scheduled_shifts"),
        *[F.sum(name).alias(f"{name}_4weeks") for name in LEVELS],
    )
    return totals.select(
        "*", *[ratio(f"{name}_4weeks", bottom).alias(name) for name, bottom in LEVELS.items()]
    )


def expected_open(denominator: Column | str = "denominator_clock_ins") -> Column:
    """Expected open locations: open days of this weekday out of four."""
    return (F.col(denominator) if isinstance(denominator, str) else denominator).cast("double") / 4.0


def month_benchmark(actuals: DataFrame, month: int = 1) -> DataFrame:
    """Reference levels from daily actuals of one calendar month.

    The fallback when no benchmark table exists. It is close to, not equal to,
    :func:`weekday_benchmark`: it averages all days with rows, including days
    without clock-ins, over a month in which a weekday may occur five times.
    """
    return (
        actuals.filter(F.month("event_date") == month)
        .groupBy(F.year("event_date").alias("yr"), "location_id", weekday_code("event_date").alias("day_of_week"))
        .agg(
            F.avg("users_with_clock_in").alias("users_with_clock_in"),
            F.avg(F.col("total_hours_worked").cast("double")).alias("total_hours_worked"),
            F.countDistinct("event_date").alias("denominator_clock_ins"),
        )
    )


def weekly_benchmark(events: DataFrame, start: date, end: date, labels: Sequence[str] = LABELS) -> DataFrame:
    """Supporting aggregate: activity per location and week of a base stretch."""
    days = location_days(events.filter(F.col("event_date").between(F.lit(start), F.lit(end))), labels)
    return days.groupBy("location_id", *labels, week_start("event_date").alias("week_start")).agg(
        F.count(F.when(F.col("has_clock_in") == 1, 1)).alias("open_days"),
        *[F.sum(name).alias(name) for name in LEVELS],
    )


def team_sizes(events: DataFrame, start: date, end: date) -> DataFrame:
    """Mean weekly number of workers with a clock-in per location."""
    weekly = (
        events.filter(F.col("event_date").between(F.lit(start), F.lit(end)) & (F.col("has_clock_in") == 1))
        .groupBy("location_id", week_start("event_date").alias("week_start"))
        .agg(F.countDistinct("user_id").alias("workers"))
    )
    return weekly.groupBy("location_id").agg(
        F.avg("workers").alias("avg_weekly_users"), F.count(F.lit(1)).alias("active_weeks")
    )
