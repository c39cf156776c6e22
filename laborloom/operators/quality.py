"""Data quality and suppression checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborloom.functions.calendar import day_spine
from laborloom.functions.ratios import half_up
from laborloom.operators.index import daily_actuals, daily_index


def freshness(sources: Sequence[tuple[DataFrame, dict[str, str]]], cutoff: date) -> DataFrame:
    """Latest date of each source against the report cutoff.

    ``sources`` pairs a table with {label: date column}; a table is read once
    for all of its date columns.
    """
    rows = []
    for df, columns in sources:
        latest = df.agg(*[F.max(F.col(column).cast("date")).alias(f"c{i}") for i, column in enumerate(columns.values())])
        entries = [
            F.struct(F.lit(label).alias("source"), F.col(f"c{i}").alias("latest")) for i, label in enumerate(columns)
        ]
        rows.append(latest.select(F.inline(F.array(*entries))))
    every = reduce(lambda left, right: left.unionByName(right), rows)
    return every.withColumn("fresh", F.coalesce(F.col("latest") >= F.lit(cutoff), F.lit(False)))


def weekday_symmetry(benchmarks: DataFrame) -> DataFrame:
    """Benchmark rows per year and weekday; equal counts are expected."""
    return benchmarks.groupBy("yr", "day_of_week").agg(F.count(F.lit(1)).alias("location_count"))


def days_with_data(benchmarks: DataFrame, expected: int = 4) -> DataFrame:
    """Range of days behind the benchmark rows and how many fall short."""
    short = F.count(F.when(F.col("days_with_data") != expected, 1))
    return benchmarks.groupBy("yr").agg(
        F.min("days_with_data").alias("min_days"),
        F.max("days_with_data").alias("max_days"),
        short.alias("incomplete_rows"),
    )


def duplicate_benchmark_keys(benchmarks: DataFrame) -> DataFrame:
    """Location-weekdays with several rows: these count repeatedly in the index."""
    return (
        benchmarks.groupBy("yr", "location_id", "day_of_week")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def spot_check(events: DataFrame, benchmarks: DataFrame, year: int) -> DataFrame:
    """Daily relative level of one year, to compare with a published series."""
    actuals = daily_actuals(events, date(year, 1, 1), date(year, 12, 31))
    return daily_index(actuals, benchmarks.filter(F.col("yr") == year)).select(
        "event_date",
        F.col("idx_employees").alias("rel_employees_working"),
        F.col("idx_hours").alias("rel_hours_worked"),
        F.col("idx_open").alias("rel_businesses_open"),
    )


def suppress_small(df: DataFrame, count: str, minimum: int) -> DataFrame:
    """Drop published groups with fewer than ``minimum`` members."""
    return df.filter(F.col(count) >= minimum)


def missing_days(series: DataFrame, first: date, last: date) -> DataFrame:
    """Days of the range a daily series lacks."""
    present = series.select("event_date").filter(F.col("event_date").between(F.lit(first), F.lit(last))).distinct()
    return day_spine(series.sparkSession, first, last).join(present, "event_date", "left_anti")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count, null rate and range per column, in one pass, in long form."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for name in columns:
        value = F.col(name).cast("double")
        measures += [F.count(name).alias(f"{name}__n"), F.min(value).alias(f"{name}__lo"), F.max(value).alias(f"{name}__hi")]
    wide = df.agg(*measures)
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.col("rows"),
            (F.col("rows") - F.col(f"{name}__n")).alias("nulls"),
            F.col(f"{name}__lo").alias("min_value"),
            F.col(f"{name}__hi").alias("max_value"),
        )
        for name in columns
    ]
    long = wide.select(F.inline(F.array(*entries)))
    rate = F.col("nulls").cast("double") / F.nullif(F.col("rows").cast("double"), F.lit(0.0))
    return long.withColumn("null_rate", half_up(rate, 6))


def contract_violations(events: DataFrame) -> DataFrame:
    """Rows that break the nullability rules of the shift event table."""
    clocked = F.col("has_clock_in") == 1

    def count(condition) -> "F.Column":
        return F.count(F.when(condition, 1))

    return events.agg(
        F.count(F.lit(1)).alias("rows"),
        count(clocked & F.col("timecard_id").isNull()).alias("clock_in_without_timecard"),
        count(~clocked & F.col("timecard_id").isNotNull()).alias("timecard_without_clock_in"),
        count(~clocked & F.col("hours_worked").isNotNull()).alias("hours_without_clock_in"),
        count(F.col("hours_scheduled").isNull()).alias("missing_scheduled_hours"),
        count(F.col("hourly_wage_rate") >= 100).alias("implausible_rate"),
        count(F.col("event_date").isNull() | F.col("location_id").isNull()).alias("missing_key"),
    )
