"""Hiring, turnover and shifts worked."""

from __future__ import annotations

from datetime import timedelta

from catalog.adapter_sql import close, half_up, using
from catalog.common import ANCHOR, AS_OF, SERIES_START
from laborloom.operators import roster
from laborloom.periods import month_open
from laborloom.sources import star_adapter as sample

FIRST, LAST = SERIES_START, ANCHOR.report_end


def _info(spark, sf):
    return roster.location_info(sample.companies(spark, sf), sample.locations(spark, sf), AS_OF)


def _hiring(spark, sf):
    return roster.hiring(sample.jobs(spark, sf), _info(spark, sf), FIRST, LAST)


def _turnover(spark, sf, **options):
    return roster.turnover(
        sample.jobs(spark, sf), sample.job_versions(spark, sf), _info(spark, sf), FIRST, LAST, horizon=None, **options
    )


QUERIES = {
    "location_info": _info,
    "hiring": _hiring,
    "hiring_per_location": lambda s, d: roster.per_location(_hiring(s, d)),
    "first_hires": lambda s, d: roster.first_hires(sample.jobs(s, d), _info(s, d), FIRST, LAST),
    "hire_dates": lambda s, d: roster.hire_dates(sample.jobs(s, d)),
    "turnover": _turnover,
    "turnover_deduped": lambda s, d: _turnover(s, d, dedupe=True),
    "turnover_per_location": lambda s, d: roster.per_location(_turnover(s, d)),
    "turnover_variance": lambda s, d: roster.yearly_variance(_turnover(s, d)),
    "archive_actors": lambda s, d: roster.archive_actors(sample.jobs(s, d), sample.job_versions(s, d), FIRST, LAST),
    "shifts_worked": lambda s, d: roster.shifts_worked(
        sample.shift_events(s, d, month_open(FIRST), LAST), _info(s, d), FIRST, LAST
    ),
}

# ---------------------------------------------------------------- SQL twins

_INFO = f"""
    SELECT location_id, c.company_id, c.created_at AS company_created_date, l.created_at AS location_created_date,
           naics_code, msa, state_cleaned AS state, business_type_new AS business_type,
           business_category_new AS business_category
    FROM locations l JOIN companies c USING (company_id)
    WHERE c.created_at < DATE '{AS_OF - timedelta(days=365)}'
      AND state_cleaned <> 'Not USA' AND state_cleaned <> 'Unclassified'
      AND (msa, naics_code, business_type_new, business_category_new) IS NOT NULL
      AND msa IS NOT NULL AND naics_code IS NOT NULL AND business_type_new IS NOT NULL AND business_category_new IS NOT NULL"""
_SYSTEM = " OR ".join(f"whodunnit ILIKE '{pattern}'" for pattern in roster.SYSTEM_ACTORS)
_AUDITED = f"""
    SELECT j.location_id, j.archived_at FROM jobs j
    JOIN job_versions v ON v.item_id = j.id AND v.created_at = j.archived_at
    WHERE whodunnit IS NOT NULL AND NOT ({_SYSTEM})"""
_ORGANIC = f"""
    SELECT j.location_id, j.archived_at FROM jobs j
    WHERE archived_at IS NOT NULL AND NOT EXISTS (
        FROM job_versions v WHERE v.item_id = j.id AND v.created_at = j.archived_at AND ({_SYSTEM}))"""


def _series(source: str, day: str) -> str:
    return f"""
        SELECT {close(day)} AS period_end, count(DISTINCT location_id) AS ss, count(*) AS timeseries_data
        FROM {source} JOIN info USING (location_id)
        WHERE {day} BETWEEN DATE '{month_open(FIRST)}' AND DATE '{LAST}'
          AND company_created_date < CAST({close(day)} - INTERVAL 12 MONTH AS DATE) + 1
        GROUP BY 1"""


_PER_LOC = f"""
    SELECT period_end, ss, timeseries_data, per_loc,
           {half_up('per_loc / lag(per_loc) OVER (ORDER BY period_end) - 1', 4)} AS mom_pct,
           {half_up('(per_loc - jan) / nullif(jan, 0) * 100', 2)} AS indexed
    FROM (SELECT *, max(per_loc) FILTER (month(period_end) = 1) OVER (PARTITION BY year(period_end)) AS jan
          FROM (SELECT *, {half_up('timeseries_data / ss', 4)} AS per_loc FROM series))"""

SQL = {
    "location_info": using("locations companies", "SELECT * FROM info", info=_INFO),
    "hiring": using("locations companies jobs", _series("jobs", "jobs.created_at"), info=_INFO),
    "hiring_per_location": using(
        "locations companies jobs", _PER_LOC, info=_INFO, series=_series("jobs", "jobs.created_at")
    ),
    "first_hires": using(
        "locations companies jobs",
        _series("hires", "hired"),
        info=_INFO,
        hires="SELECT user_id, location_id, min(created_at) AS hired FROM jobs GROUP BY ALL",
    ),
    "hire_dates": using("jobs", "SELECT user_id, location_id, min(created_at) AS created_at FROM jobs GROUP BY ALL"),
    "turnover": using(
        "locations companies job_versions", _series("gone", "archived_at"), info=_INFO, gone=_AUDITED
    ),
    "turnover_deduped": using(
        "locations companies job_versions", _series("gone", "archived_at"), info=_INFO, gone=_ORGANIC
    ),
    "turnover_per_location": using(
        "locations companies job_versions", _PER_LOC, info=_INFO, gone=_AUDITED, series=_series("gone", "archived_at")
    ),
    "turnover_variance": using(
        "locations companies job_versions",
        f"""SELECT period_end, timeseries_data, year_before, {half_up('timeseries_data / year_before - 1', 4)} AS yoy_change,
                   abs(timeseries_data / year_before - 1) > 0.05 AS needs_review
            FROM (SELECT a.period_end, a.timeseries_data, b.timeseries_data AS year_before FROM series a
                  LEFT JOIN series b ON b.period_end = CAST(a.period_end - INTERVAL 12 MONTH AS DATE))""",
        info=_INFO,
        gone=_AUDITED,
        series=_series("gone", "archived_at"),
    ),
    "archive_actors": using(
        "job_versions",
        f"""SELECT {close('archived_at')} AS period_end,
                   CASE WHEN whodunnit IS NULL THEN 'unknown'
                        WHEN whodunnit ILIKE '%archive_invoiced_company%' THEN 'rake businesses:archive_invoiced_company'
                        WHEN whodunnit ILIKE '%lockjobworker%' THEN 'lockjobworker'
                        WHEN whodunnit ILIKE '%handlejobterminationworker%' THEN 'handlejobterminationworker'
                        ELSE 'person' END AS actor, count(*) AS archives
            FROM jobs j JOIN job_versions v ON v.item_id = j.id AND v.created_at = j.archived_at
            WHERE archived_at BETWEEN DATE '{month_open(FIRST)}' AND DATE '{LAST}' GROUP BY ALL""",
    ),
    "shifts_worked": using(
        "locations companies shift_events",
        _series("cards", "carded"),
        info=_INFO,
        cards="SELECT location_id, CAST(timecard_created_at AS DATE) AS carded FROM shift_events WHERE has_clock_in = 1",
    ),
}
