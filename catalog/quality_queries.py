"""Checks, profiles, the overview and reshaped series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog import index_queries, roster_queries, wage_queries
from catalog.adapter_sql import half_up, using
from catalog.common import ANCHOR, AS_OF, LABOR_START, SERIES_START, WINDOWS, rounded
from laborloom.operators import quality as qa
from laborloom.operators.index import daily_actuals
from laborloom.operators.reuse import shared_path
from laborloom.plans.publish import published_overview
from laborloom.plans.monthly import MonthlyInputs, MonthlyReport
from laborloom.sources import star_adapter as sample

CUTOFF = ANCHOR.report_end
PROFILED = ("hours_worked", "hourly_wage_rate", "total_wages_earned", "timecard_id")
GAP_SPAN = (date(1994, 12, 1), date(2001, 11, 30))


def report(spark, sf) -> MonthlyReport:
    tables = MonthlyInputs(
        events=sample.shift_events(spark, sf, LABOR_START, AS_OF),
        payroll_runs=sample.payroll_runs(spark, sf),
        locations=sample.locations(spark, sf),
        companies=sample.companies(spark, sf),
        jobs=sample.jobs(spark, sf),
        job_versions=sample.job_versions(spark, sf),
    )
    return MonthlyReport(
        tables,
        AS_OF,
        labor_start=LABOR_START,
        wage_start=wage_queries.START,
        roster_start=SERIES_START,
        base_month=wage_queries.BASE,
        turnover_horizon=None,
    )


def _freshness(spark, sf):
    return qa.freshness(
        [
            (sample.shift_events(spark, sf), {"events": "event_date"}),
            (sample.payroll_runs(spark, sf), {"payroll": "payday"}),
            (sample.jobs(spark, sf), {"roster created": "created_at", "roster archived": "archived_at"}),
        ],
        CUTOFF,
    )


def _regional_days(spark, sf):
    """Region-days with at least three locations, the rest suppressed."""
    actuals = daily_actuals(sample.shift_events(spark, sf, LABOR_START, AS_OF), LABOR_START, AS_OF, ["region"])
    daily = actuals.groupBy("event_date", "region").agg(
        F.sum("is_open").alias("open_locations"), F.count(F.lit(1)).alias("locations")
    )
    return qa.suppress_small(daily, "locations", 3)


def _published_overview(spark, sf):
    """The overview through a written table, its shared aggregates staged once and removed."""
    path = shared_path(spark, "overview")
    if path is None:
        raise ValueError("set spark.checkpoint.dir: the query goes through a written table")
    return rounded(published_overview(report(spark, sf), WINDOWS, path), 6, "value")


QUERIES = {
    "freshness": _freshness,
    "missing_days": lambda s, d: qa.missing_days(sample.shift_events(s, d), *GAP_SPAN),
    "column_profile": lambda s, d: qa.column_profile(sample.shift_events(s, d), PROFILED),
    "contract_violations": lambda s, d: qa.contract_violations(sample.shift_events(s, d)),
    "suppressed_region_days": _regional_days,
    "overview": lambda s, d: rounded(report(s, d).overview(WINDOWS), 6, "value"),
    "overview_published": _published_overview,
}

# ---------------------------------------------------------------- SQL twins

_PROFILE = " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", count(*) AS rows, count(*) - count({name}) AS nulls,
               CAST(min({name}) AS DOUBLE) AS min_value, CAST(max({name}) AS DOUBLE) AS max_value,
               {half_up(f'CAST(count(*) - count({name}) AS DOUBLE) / count(*)', 6)} AS null_rate
        FROM shift_events"""
    for name in PROFILED
)


def _card(metric: str, unit: str, source: str, order: str, value: str, change: str | None, extra: str) -> str:
    move = change or half_up(f"(max({value}) FILTER (r = 1)) - (max({value}) FILTER (r = 2))", 2)
    return f"""
        SELECT '{metric}' AS metric, CAST(max({value}) FILTER (r = 1) AS DOUBLE) AS value, '{unit}' AS unit,
               {move} AS mom_change, {extra}
        FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM {source})"""


_NONE = "CAST(NULL AS DOUBLE)"
_BARE = f"{_NONE} AS pct_above_base, {_NONE} AS indexed"
_LAB = ("labor", "year DESC, month DESC")
_OVERVIEW = " UNION ALL ".join(
    [
        _card(f"{name}", "% vs Jan baseline", *_LAB, f"{name}_pct", f"max({change}) FILTER (r = 1)", _BARE)
        for name, change in (
            ("employees_working", "employees_mom_ppt"),
            ("hours_worked", "hours_mom_ppt"),
            ("businesses_open", "open_mom_ppt"),
        )
    ]
    + [
        _card(
            "hourly_wages",
            "$/hr",
            "pay",
            "period_end DESC",
            "wage_rate",
            None,
            f"max(pct_above_base) FILTER (r = 1) AS pct_above_base, {_NONE} AS indexed",
        )
    ]
    + [
        _card(
            metric,
            "jobs/location",
            source,
            "period_end DESC",
            "per_loc",
            None,
            f"{_NONE} AS pct_above_base, max(indexed) FILTER (r = 1) AS indexed",
        )
        for metric, source in (("jobs_added", "hired"), ("jobs_archived", "left_"))
    ]
)

SQL = {
    "freshness": using(
        "shift_events payroll_runs jobs",
        " UNION ALL ".join(
            f"SELECT '{label}' AS source, max({column}) AS latest, coalesce(max({column}) >= DATE '{CUTOFF}', false) AS fresh FROM {table}"
            for label, table, column in (
                ("events", "shift_events", "event_date"),
                ("payroll", "payroll_runs", "payday"),
                ("roster created", "jobs", "created_at"),
                ("roster archived", "jobs", "archived_at"),
            )
        ),
    ),
    "missing_days": using(
        "shift_events",
        f"""SELECT CAST(d AS DATE) AS event_date FROM generate_series(DATE '{GAP_SPAN[0]}', DATE '{GAP_SPAN[1]}', INTERVAL 1 DAY) AS g(d)
            WHERE CAST(d AS DATE) NOT IN (SELECT event_date FROM shift_events)""",
    ),
    "column_profile": using("shift_events", _PROFILE),
    "contract_violations": using(
        "shift_events",
        """SELECT count(*) AS rows,
                  count(*) FILTER (has_clock_in = 1 AND timecard_id IS NULL) AS clock_in_without_timecard,
                  count(*) FILTER (has_clock_in <> 1 AND timecard_id IS NOT NULL) AS timecard_without_clock_in,
                  count(*) FILTER (has_clock_in <> 1 AND hours_worked IS NOT NULL) AS hours_without_clock_in,
                  count(*) FILTER (hours_scheduled IS NULL) AS missing_scheduled_hours,
                  count(*) FILTER (hourly_wage_rate >= 100) AS implausible_rate,
                  count(*) FILTER (event_date IS NULL OR location_id IS NULL) AS missing_key
           FROM shift_events""",
    ),
    "suppressed_region_days": using(
        "shift_events",
        f"""SELECT event_date, region, CAST(sum(is_open) AS BIGINT) AS open_locations, count(*) AS locations
            FROM act GROUP BY ALL HAVING count(*) >= 3""",
        act=index_queries._act("region, "),
    ),
    "overview": using(
        "shift_events payroll_runs locations companies job_versions",
        f"""SELECT metric, {half_up('value', 6)} AS value, unit, mom_change, pct_above_base, indexed FROM cards""",
        **index_queries._chain(),
        labor=index_queries._report(),
        cohort=wage_queries._COHORT,
        dated=wage_queries._DATED,
        pooled=wage_queries._POOLED,
        nat=wage_queries._mean("", "pooled", digits=None),
        pay=f"SELECT period_end, wage_rate, sample_size_jobs, {wage_queries._above_base()} FROM nat",
        info=roster_queries._INFO,
        gone=roster_queries._AUDITED,
        series=roster_queries._series("jobs", "jobs.created_at"),
        hired=roster_queries._PER_LOC,
        series2=roster_queries._series("gone", "archived_at"),
        left_=roster_queries._PER_LOC.replace("FROM series", "FROM series2"),
        cards=_OVERVIEW,
    ),
}
SQL["overview_published"] = SQL["overview"]
