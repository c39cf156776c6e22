"""Calendar columns and period spines.

Weeks and reporting months partition the calendar, so the period of a row is a
function of its date. Deriving it as a column turns every "date between period
start and period end" join into an equality on that column.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.periods import week_floor


def _col(day: Column | str) -> Column:
    return F.col(day) if isinstance(day, str) else day


def week_start(day: Column | str, first: str = "sunday") -> Column:
    day = _col(day)
    if first == "sunday":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if first == "monday":
        return F.trunc(day, "week")
    raise ValueError(f"weeks start on 'sunday' or 'monday', not {first!r}")


def weekday_code(day: Column | str) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(_col(day)) - 1


def month_close(day: Column | str) -> Column:
    """Closing 27th of the reporting month (28th to 27th) that holds ``day``.

    Going back 27 days lands in the calendar month before the closing one for
    every day of the reporting month.
    """
    return F.date_add(F.add_months(F.trunc(F.date_sub(_col(day), 27), "month"), 1), 26)


def month_open(close: Column | str) -> Column:
    return F.date_add(F.add_months(_col(close), -1), 1)


def trailing_year_open(close: Column | str) -> Column:
    return F.date_add(F.add_months(_col(close), -12), 1)


def anchor_sunday(year: Column, month: Column) -> Column:
    """Sunday on or before the 12th of a month."""
    return week_start(F.make_date(year, month, F.lit(12)))


def in_anchor_week(day: Column | str) -> Column:
    """True for the seven days from the anchor Sunday of the day's own month.

    The anchor Sunday is the 6th to 12th, so its week never leaves the month
    and membership needs no join to a calendar.
    """
    day = _col(day)
    return week_start(day) == anchor_sunday(F.year(day), F.month(day))


def iso_week(day: Column | str) -> Column:
    return F.weekofyear(_col(day))


def iso_year(day: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(day))


def window_year(day: Column | str, windows: dict[int, tuple[date, date]]) -> Column:
    """Year of the reference window that holds ``day``, NULL outside all of them."""
    day = _col(day)
    hits = [F.when(day.between(F.lit(lo), F.lit(hi)), F.lit(year)) for year, (lo, hi) in windows.items()]
    return F.coalesce(*hits)


def in_windows(day: Column | str, windows: dict[int, tuple[date, date]]) -> Column:
    """Plain date ranges, so that the scan can prune by them."""
    day = _col(day)
    clause = F.lit(False)
    for lo, hi in windows.values():
        clause = clause | day.between(F.lit(lo), F.lit(hi))
    return clause


def _one(spark: SparkSession) -> DataFrame:
    return spark.range(1).drop("id")


def _steps(spark: SparkSession, first: date, last: date, step: str, name: str) -> DataFrame:
    days = F.sequence(F.lit(first), F.lit(last), F.expr(f"INTERVAL {step}"))
    return _one(spark).select(F.explode(days).alias(name))


def weekly_spine(spark: SparkSession, as_of: date, periods_back: int = 260, first: str = "sunday") -> DataFrame:
    """Complete weeks up to ``as_of`` with the four weeks that follow each."""
    lo = week_floor(as_of - timedelta(days=7 * periods_back), first)
    hi = week_floor(as_of, first)
    start = F.col("period_start")
    return (
        _steps(spark, lo, hi, "7 DAY", "period_start")
        .filter(F.date_add(start, 6) <= F.lit(as_of))
        .select(
            start,
            F.date_add(start, 6).alias("period_end"),
            F.date_add(start, 7).alias("future_start"),
            F.date_add(start, 34).alias("future_end"),
        )
    )


def month_spine(spark: SparkSession, first_close: date, last_close: date) -> DataFrame:
    """Reporting months from one closing date to another."""
    close = F.col("month_end")
    return _steps(spark, first_close, last_close, "1 MONTH", "month_end").select(
        trailing_year_open(close).alias("year_beginning"), month_open(close).alias("month_beginning"), close
    )


def day_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    return _steps(spark, first, last, "1 DAY", "event_date")


def reference_months(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    """(yr, mo) pairs with their anchor Sunday."""
    months = _steps(spark, date(min(years), 1, 1), date(max(years), 12, 1), "1 MONTH", "m")
    pairs = months.select(F.year("m").alias("yr"), F.month("m").alias("mo"))
    return pairs.filter(F.col("yr").isin(*years)).withColumn(
        "reference_sunday", anchor_sunday(F.col("yr"), F.col("mo"))
    )


def dates_per_key(keys: DataFrame, first: date, last: date, name: str = "event_date") -> DataFrame:
    """Complete date grid: every key row once per day.

    The day list is a literal array expanded in place on each key row, so the
    grid needs neither a join nor a shuffle.
    """
    days = F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))
    return keys.withColumn(name, F.explode(days))
