"""Calendar columns and spines, checked over all event dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapter_sql import close, monday, sunday, using
from catalog.common import ANCHOR, AS_OF, SERIES_START, WINDOW_ROWS, WINDOWS
from laborloom.functions import calendar as cal
from laborloom.sources import star_adapter as sample


def _calendar(spark, sf):
    days = sample.shift_events(spark, sf).groupBy("event_date").agg(F.count(F.lit(1)).alias("shifts"))
    close_day = cal.month_close("event_date")
    return days.select(
        "event_date",
        "shifts",
        cal.week_start("event_date").alias("sunday_week"),
        cal.week_start("event_date", "monday").alias("monday_week"),
        cal.weekday_code("event_date").alias("weekday"),
        cal.iso_week("event_date").alias("iso_week"),
        cal.iso_year("event_date").cast("int").alias("iso_year"),
        close_day.alias("month_end"),
        cal.month_open(close_day).alias("month_beginning"),
        cal.trailing_year_open(close_day).alias("year_beginning"),
        cal.in_anchor_week("event_date").alias("in_anchor_week"),
        cal.window_year("event_date", WINDOWS).alias("window_year"),
    )


def _weeks(spark, sf):
    """Weekly spine with the shifts of each complete week, empty weeks included."""
    events = sample.shift_events(spark, sf)
    weekly = events.groupBy(cal.week_start("event_date").alias("period_start")).agg(F.count(F.lit(1)).alias("shifts"))
    return cal.weekly_spine(spark, AS_OF).join(weekly, "period_start", "left").fillna(0, ["shifts"])


def _months(spark, sf):
    events = sample.shift_events(spark, sf)
    monthly = events.groupBy(cal.month_close("event_date").alias("month_end")).agg(F.count(F.lit(1)).alias("shifts"))
    return cal.month_spine(spark, SERIES_START, ANCHOR.report_end).join(monthly, "month_end", "left")


def _anchor_weeks(spark, sf):
    """Anchor Sundays with the shifts of their week."""
    events = sample.shift_events(spark, sf).filter(cal.in_anchor_week("event_date"))
    weekly = events.groupBy(cal.week_start("event_date").alias("reference_sunday")).agg(
        F.count(F.lit(1)).alias("shifts")
    )
    return cal.reference_months(spark, sample.BENCHMARK_YEARS).join(weekly, "reference_sunday", "left")


QUERIES = {
    "calendar_columns": _calendar,
    "weekly_spine": _weeks,
    "month_end_spine": _months,
    "anchor_weeks": _anchor_weeks,
}

_SUN12 = "CAST(make_date(yr, mo, 12) - CAST(dayofweek(make_date(yr, mo, 12)) AS INTEGER) AS DATE)"

SQL = {
    "calendar_columns": using(
        "shift_events",
        f"""SELECT event_date, count(*) AS shifts, {sunday('event_date')} AS sunday_week, {monday('event_date')} AS monday_week,
                   CAST(dayofweek(event_date) AS INTEGER) AS weekday, CAST(week(event_date) AS INTEGER) AS iso_week,
                   CAST(isoyear(event_date) AS INTEGER) AS iso_year, {close('event_date')} AS month_end,
                   CAST(CAST({close('event_date')} - INTERVAL 1 MONTH AS DATE) + 1 AS DATE) AS month_beginning,
                   CAST(CAST({close('event_date')} - INTERVAL 12 MONTH AS DATE) + 1 AS DATE) AS year_beginning,
                   event_date - {_SUN12.replace('yr', 'year(event_date)').replace('mo,', 'month(event_date),')} BETWEEN 0 AND 6 AS in_anchor_week,
                   CAST((SELECT max(yr) FROM (VALUES {WINDOW_ROWS}) w(yr, lo, hi) WHERE event_date BETWEEN lo AND hi) AS INTEGER) AS window_year
            FROM shift_events GROUP BY event_date""",
    ),
    "weekly_spine": using(
        "shift_events",
        f"""SELECT period_start, CAST(period_start + 6 AS DATE) AS period_end, CAST(period_start + 7 AS DATE) AS future_start,
                   CAST(period_start + 34 AS DATE) AS future_end, coalesce(shifts, 0) AS shifts
            FROM (SELECT CAST(d AS DATE) AS period_start
                  FROM generate_series({sunday(f"(DATE '{AS_OF}' - 1820)")}, DATE '{AS_OF}' - 6, INTERVAL 7 DAY) AS g(d))
            LEFT JOIN (SELECT {sunday('event_date')} AS period_start, count(*) AS shifts FROM shift_events GROUP BY ALL)
                 USING (period_start)""",
    ),
    "month_end_spine": using(
        "shift_events",
        f"""SELECT month_end, CAST(CAST(month_end - INTERVAL 12 MONTH AS DATE) + 1 AS DATE) AS year_beginning,
                   CAST(CAST(month_end - INTERVAL 1 MONTH AS DATE) + 1 AS DATE) AS month_beginning, shifts
            FROM (SELECT CAST(d AS DATE) AS month_end
                  FROM generate_series(DATE '{SERIES_START}', DATE '{ANCHOR.report_end}', INTERVAL 1 MONTH) AS g(d))
            LEFT JOIN (SELECT {close('event_date')} AS month_end, count(*) AS shifts FROM shift_events GROUP BY ALL)
                 USING (month_end)""",
    ),
    "anchor_weeks": using(
        "shift_events",
        f"""SELECT reference_sunday, CAST(yr AS INTEGER) AS yr, CAST(mo AS INTEGER) AS mo, count(shift_id) AS shifts
            FROM (SELECT yr, mo, {_SUN12} AS reference_sunday
                  FROM range({min(sample.BENCHMARK_YEARS)}, {max(sample.BENCHMARK_YEARS) + 1}) y(yr), range(1, 13) m(mo))
            LEFT JOIN shift_events ON event_date BETWEEN reference_sunday AND reference_sunday + 6
            GROUP BY ALL""",
    ),
}
# Months without any shift keep a NULL count on the Spark side.
SQL["anchor_weeks"] = SQL["anchor_weeks"].replace("count(shift_id) AS shifts", "nullif(count(shift_id), 0) AS shifts")
