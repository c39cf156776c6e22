"""Event impact."""

from __future__ import annotations

from dataclasses import replace

from catalog.adapter_sql import half_up, monday, quotient, rounded as ratio_sql, using
from catalog.common import AS_OF, DATES, SCOPE, rounded
from laborloom.operators import impact
from laborloom.plans.event_report import EventReport
from laborloom.sources import star_adapter as sample

OPEN_ENDED = replace(SCOPE, event_end=None)


def _report(spark, sf, scope=SCOPE, **options):
    report = EventReport(sample.timeclock(spark, sf), scope, AS_OF, **{"check": False, **options})
    scoped = sample.timeclock(spark, sf, report.dates.data_start, report.dates.data_end)
    return replace(report, timeclock=scoped)


def _deltas(spark, sf, **options):
    return rounded(_report(spark, sf, **options).deltas(), 6, "current_value", "prior_value", "yoy_delta", "yoy_pct")


QUERIES = {
    "city_discovery": lambda s, d: impact.discover_cities(sample.timeclock(s, d), "asia", AS_OF),
    "event_weekly_metrics": lambda s, d: _report(s, d).weekly(),
    "event_weekly_metrics_calendar_year": lambda s, d: _report(s, d, literal_years=True).weekly(),
    "event_yearly_deltas": _deltas,
    "event_yearly_deltas_open_ended": lambda s, d: _deltas(s, d, scope=OPEN_ENDED),
    "event_yearly_deltas_calendar_year": lambda s, d: _deltas(s, d, literal_years=True),
    "event_yearly_deltas_suppressed": lambda s, d: _deltas(s, d, suppress=True),
    "event_period_summary": lambda s, d: rounded(_report(s, d).summary(), 6, "mean_delta", "sd_delta", "se_delta"),
    "event_significance": lambda s, d: rounded(
        _report(s, d).significance(), 6, "avg_delta", "diff", "t_stat", "df", "p_value"
    ),
    "event_input_check": lambda s, d: impact.check_weeks(_report(s, d).weekly(), SCOPE),
}

# ---------------------------------------------------------------- SQL twins

_BANDS = "('5–9 employees', '10–19 employees', '20–49 employees', '50–99 employees')"


def _weekly(year: str) -> str:
    return f"""
        SELECT CAST({year}(event_date) AS INTEGER) AS yr, {monday('event_date')} AS week_start,
               CAST(week(event_date) AS INTEGER) AS iso_week,
               count(DISTINCT location_id) FILTER (has_clock_in = 1) AS businesses_open,
               count(DISTINCT location_id) AS active_locs,
               count(DISTINCT user_id) FILTER (has_clock_in = 1) AS employees_working,
               {half_up('coalesce(sum(hours_worked), 0)', 2)} AS hours_worked
        FROM timeclock
        WHERE event_date >= DATE '{DATES.data_start}' AND event_date <= DATE '{DATES.data_end}'
          AND upper(city) = '{SCOPE.city}' AND loc_archived_at IS NULL
          AND employee_count IN {_BANDS} AND location_age >= 84
        GROUP BY ALL"""


_METRICS = f"""
    SELECT *, {ratio_sql('employees_working', 'active_locs', 3)} AS emp_per_loc,
           {ratio_sql('hours_worked', 'active_locs', 3)} AS hrs_per_loc,
           active_locs < {SCOPE.min_locations} AS thin_sample
    FROM wkly"""
_PERIOD = f"""
    CASE WHEN week_start >= DATE '{DATES.pre_start}' AND week_start < DATE '{SCOPE.event_start}' THEN 'pre-event'
         WHEN week_start >= DATE '{SCOPE.event_start}' AND week_start <= DATE '{SCOPE.event_end}' THEN 'during'
         WHEN week_start > DATE '{SCOPE.event_end}' AND week_start <= DATE '{DATES.post_end}' THEN 'post-event'
         ELSE 'baseline' END"""


def _period(scope, dates) -> str:
    if scope.event_end:
        return _PERIOD
    return f"CASE WHEN week_start BETWEEN DATE '{dates.pre_start}' AND DATE '{dates.safe_end}' THEN 'pre-event' ELSE 'baseline' END"


def _delta_rows(period: str = _PERIOD, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, c.iso_week, c.week_start, {period.replace('week_start', 'c.week_start')} AS period,
                   CAST(c.{m} AS DOUBLE) AS cur, CAST(p.{m} AS DOUBLE) AS pri
            FROM (FROM metrics WHERE {where}) c JOIN (FROM metrics WHERE {where}) p
              ON p.iso_week = c.iso_week AND p.yr = c.yr - 1
            WHERE c.yr = (SELECT max(yr) FROM metrics WHERE {where})"""
        for m in impact.METRICS
    )


_SHOW_DELTAS = f"""
    SELECT metric, iso_week, week_start, period, {half_up('cur', 6)} AS current_value, {half_up('pri', 6)} AS prior_value,
           {half_up('cur - pri', 6)} AS yoy_delta, {half_up(quotient('cur - pri', 'abs(pri)') + ' * 100', 6)} AS yoy_pct
    FROM deltas"""
_CHAIN = dict(wkly=_weekly("isoyear"), metrics=_METRICS)

# Midpoint rule on the plain angle integral: independent of the operator's grid.
_P_VALUE = """(SELECT sum(pow(cos(th + (pi() / 2 - th) * (i + 0.5) / 20000), df - 1)) * (pi() / 2 - th)
                    / (sum(pow(cos(pi() / 2 * (i + 0.5) / 20000), df - 1)) * pi() / 2)
               FROM (SELECT unnest(range(20000)) AS i))"""
_WELCH = f"""
    SELECT metric, period, n AS weeks, {half_up('m', 6)} AS avg_delta, {half_up('m - bm', 6)} AS diff,
           CASE WHEN m > bm THEN 'up' ELSE 'down' END AS direction,
           {half_up('t', 6)} AS t_stat, {half_up('df', 6)} AS df, {half_up(_P_VALUE, 6)} AS p_value,
           {_P_VALUE} < 0.05 AS significant
    FROM (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM (
        SELECT *, (m - bm) / sqrt(nullif(v / n + bv / bn, 0)) AS t,
               pow(nullif(v / n + bv / bn, 0), 2) / (pow(v / n, 2) / (n - 1) + pow(bv / bn, 2) / (bn - 1)) AS df
        FROM st JOIN (SELECT metric, n AS bn, m AS bm, v AS bv FROM st WHERE period = 'baseline') USING (metric)
        WHERE period <> 'baseline' AND n >= 2 AND bn >= 2))"""
_STATS = """
    SELECT metric, period, count(*) AS n, avg(cur - pri) AS m, var_samp(cur - pri) AS v FROM deltas GROUP BY ALL"""

SQL = {
    "city_discovery": using(
        "timeclock",
        f"""SELECT upper(city) AS city_upper, state, count(DISTINCT location_id) AS locations,
                   count(DISTINCT company_id) AS companies
            FROM timeclock WHERE city ILIKE '%asia%' AND loc_archived_at IS NULL
              AND event_date >= DATE '{AS_OF}' - 90 GROUP BY ALL""",
    ),
    "event_weekly_metrics": using("timeclock", "SELECT * FROM metrics", **_CHAIN),
    "event_weekly_metrics_calendar_year": using(
        "timeclock", "SELECT * FROM metrics", wkly=_weekly("year"), metrics=_METRICS
    ),
    "event_yearly_deltas": using("timeclock", _SHOW_DELTAS, **_CHAIN, deltas=_delta_rows()),
    "event_yearly_deltas_open_ended": using(
        "timeclock",
        _SHOW_DELTAS,
        wkly=_weekly("isoyear").replace(str(DATES.data_end), str(DATES.safe_end)),
        metrics=_METRICS,
        deltas=_delta_rows(_period(OPEN_ENDED, DATES)),
    ),
    "event_yearly_deltas_calendar_year": using(
        "timeclock", _SHOW_DELTAS, wkly=_weekly("year"), metrics=_METRICS, deltas=_delta_rows()
    ),
    "event_yearly_deltas_suppressed": using(
        "timeclock", _SHOW_DELTAS, **_CHAIN, deltas=_delta_rows(where="NOT thin_sample")
    ),
    "event_period_summary": using(
        "timeclock",
        f"""SELECT metric, period, {half_up('avg(cur - pri)', 6)} AS mean_delta, {half_up('stddev_samp(cur - pri)', 6)} AS sd_delta,
                   {half_up('stddev_samp(cur - pri) / sqrt(count(*))', 6)} AS se_delta, count(*) AS weeks
            FROM deltas GROUP BY ALL""",
        **_CHAIN,
        deltas=_delta_rows(),
    ),
    "event_significance": using("timeclock", _WELCH, **_CHAIN, deltas=_delta_rows(), st=_STATS),
    "event_input_check": using(
        "timeclock",
        f"""SELECT '{SCOPE.city}' AS city, CAST(coalesce(sum(n), 0) AS BIGINT) AS week_rows,
                   coalesce(max(y), 0) AS years_sharing_a_week, count(*) FILTER (y > 1) AS shared_weeks,
                   CASE WHEN count(*) = 0 THEN 'no rows in scope' WHEN max(y) > 1 THEN 'ok'
                        ELSE 'no overlapping weeks in two years' END AS verdict
            FROM (SELECT iso_week, count(*) AS n, count(DISTINCT yr) AS y FROM metrics GROUP BY ALL)""",
        **_CHAIN,
    ),
}
