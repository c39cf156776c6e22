"""Parameters and small helpers shared by the registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborloom.functions.ratios import half_up
from laborloom.periods import EventScope, event_dates, report_anchor, sunday_window
from laborloom.sources import star_adapter as sample

AS_OF = sample.AS_OF
WINDOWS = {year: sunday_window(year) for year in sample.BENCHMARK_YEARS}
LABOR_START = date(1999, 1, 1)
SERIES_START = date(1999, 1, 27)
ANCHOR = report_anchor(AS_OF)
SCOPE = EventScope(event_start=date(2001, 6, 4), event_end=date(2001, 7, 8), city="ASIA CITY", min_locations=3)
DATES = event_dates(SCOPE, AS_OF)

WINDOW_ROWS = ", ".join(f"({y}, DATE '{a}', DATE '{b}')" for y, (a, b) in WINDOWS.items())


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Sums of doubles depend on their order; compare them to a few digits."""
    return df.withColumns({name: half_up(name, digits) for name in names})


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})
