"""Publish the derived tables and report extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import nullcontext
from datetime import date

from pyspark.sql import DataFrame

from laborloom.operators.benchmark import weekday_benchmark
from laborloom.operators.reuse import shared_frames, shared_path
from laborloom.operators.weekly import weekly_table
from laborloom.plans.gate import Finding, benchmark_rules, publish
from laborloom.plans.monthly import MonthlyReport
from laborloom.sources.sinks import replace_table, write_csv


# Fixed value: groups of fewer locations are not published.
MIN_LOCATIONS = 30


def publish_benchmarks(events: DataFrame, windows: dict[int, tuple[date, date]], path: str) -> DataFrame:
    """Rebuild the years in ``windows`` of the benchmark table, leaving others."""
    replace_table(weekday_benchmark(events, windows), path, ["yr"])
    return events.sparkSession.read.parquet(path)


def publish_checked_benchmarks(
    events: DataFrame, windows: dict[int, tuple[date, date]], path: str, asymmetric: float = 0.0, short: float = 0.0
) -> list[Finding]:
    """Rebuild the years in ``windows`` behind the gate: a year that breaks a rule never becomes visible.

    Raises ``gate.Rejected`` for the first such year; years before it are published.
    """
    rules = benchmark_rules(asymmetric=asymmetric, short=short)
    findings = []
    for year, window in sorted(windows.items()):
        findings += publish(weekday_benchmark(events, {year: window}), path, rules, partition_by="yr")
    return findings


def publish_weekly(
    timeclock: DataFrame,
    as_of: date,
    path: str,
    by: Sequence[str] = (),
    min_locations: int | None = MIN_LOCATIONS,
    cuts: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Rebuild the weekly table, national, by location attribute or in all ``cuts`` at once.

    ``min_locations=None`` keeps thin groups.
    """
    replace_table(weekly_table(timeclock, as_of, by, min_locations=min_locations, cuts=cuts), path)
    return timeclock.sparkSession.read.parquet(path)


def export_monthly(
    report: MonthlyReport,
    folder: str,
    windows: dict[int, tuple[date, date]] | None = None,
    min_locations: int | None = MIN_LOCATIONS,
) -> list[str]:
    """Write each series of the monthly report as CSV in order; returns the paths.

    Groups with fewer than ``min_locations`` locations are left out of the
    labor, hiring and turnover series (None keeps them); wages have their own
    rule on jobs.

    This is the outermost level, hence the only place that sorts.
    """
    with shared_frames(report.tables.events.sparkSession) if shareable(report) else nullcontext():
        return _export(report, folder, windows, min_locations)


def shareable(report: MonthlyReport) -> bool:
    """Whether the session names a folder where the series may share tables."""
    return shared_path(report.tables.events.sparkSession, "report") is not None


def _export(
    report: MonthlyReport, folder: str, windows: dict[int, tuple[date, date]] | None, min_locations: int | None
) -> list[str]:
    series = {
        "labor": (report.labor(windows, min_locations=min_locations), ["year", "month"]),
        "wages": (report.wages(), ["segmented_by", "segment", "period_end"]),
        "hiring": (report.hiring(min_locations), ["period_end"]),
        "turnover": (report.turnover(min_locations=min_locations), ["period_end"]),
    }
    for name, (df, order) in series.items():
        write_csv(df.orderBy(*order), f"{folder}/{name}")
    return [f"{folder}/{name}" for name in series]


def published_overview(report: MonthlyReport, windows: dict[int, tuple[date, date]] | None, path: str) -> DataFrame:
    """Write the overview; the aggregates behind its cards are staged once each and removed when it is written."""
    spark = report.tables.events.sparkSession
    with shared_frames(spark):
        report.overview(windows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
