"""Benchmarks and January-indexed activity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.adapter_sql import half_up, quotient, sunday, using
from catalog.common import AS_OF, LABOR_START, WINDOW_ROWS, WINDOWS, doubles, rounded
from laborloom.functions.calendar import dates_per_key
from laborloom.operators import benchmark as bm
from laborloom.operators import index as ix
from laborloom.operators import quality as qa
from laborloom.operators.reuse import shared_path
from laborloom.plans import gate
from laborloom.plans.publish import publish_benchmarks
from laborloom.periods import sunday_window
from laborloom.sources import star_adapter as sample
from laborloom.sources.scan import date_span
from laborloom.sources.sinks import table_exists

LEVELS = list(bm.LEVELS)
# Sample locations are often closed, so the published strictness would let no year pass.
ASYMMETRIC, SHORT = 0.06, 0.9



def _events(spark, sf):
    return sample.shift_events(spark, sf, LABOR_START, AS_OF)


def _bench(spark, sf):
    return bm.weekday_benchmark(_events(spark, sf), WINDOWS)


def _actuals(spark, sf, by=()):
    return ix.daily_actuals(_events(spark, sf), LABOR_START, AS_OF, by)


def _index(spark, sf, by=(), **options):
    return ix.daily_index(_actuals(spark, sf, by), _bench(spark, sf), by, **options)


def _moved(spark, sf):
    """Events whose city spelling changes inside every benchmark window."""
    late = F.dayofmonth("event_date") > 18
    return _events(spark, sf).withColumn("city", F.when(late, F.upper("city")).otherwise(F.lower("city")))


def _moved_monthly(spark, sf, presum):
    moved = _moved(spark, sf)
    return ix.labor_index(moved, bm.weekday_benchmark(moved, WINDOWS), LABOR_START, AS_OF, presum=presum)


def _monthly(spark, sf, **options):
    return ix.labor_index(_events(spark, sf), _bench(spark, sf), LABOR_START, AS_OF, **options)


def _grid(spark, sf):
    """Complete location-by-day grid, from the first to the last day of the events, with its gaps as zero."""
    events = sample.shift_events(spark, sf)
    first, last = date_span(events, "event_date")
    keys = sample.locations(spark, sf).select("location_id")
    days = bm.location_days(events, labels=())
    grid = dates_per_key(keys, first, last).join(days, ["location_id", "event_date"], "left")
    return grid.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("locations"),
        F.count(F.when(F.col("has_clock_in") == 1, 1)).alias("open_locations"),
        F.sum(F.coalesce("users_with_clock_in", F.lit(0))).alias("users"),
    )


def _published(spark, sf):
    """The benchmark table of every year after a round through the partitioned sink."""
    path = shared_path(spark, "benchmarks")
    if path is None:
        raise ValueError("set spark.checkpoint.dir: the query goes through a written table")
    events = sample.shift_events(spark, sf)
    first, last = date_span(events, "event_date")
    stored = publish_benchmarks(events, {y: sunday_window(y) for y in range(first.year, last.year + 1)}, path)
    return rounded(stored, 6, "total_hours_scheduled_4weeks", "total_hours_worked_4weeks", *LEVELS)


def _gated(spark, sf):
    """What the writing job of each year's benchmarks has seen, and whether the year became visible."""
    path = shared_path(spark, "gated-benchmarks")
    if path is None:
        raise ValueError("set spark.checkpoint.dir: the query goes through a written table")
    rows = []
    for year, window in WINDOWS.items():
        levels = bm.weekday_benchmark(_events(spark, sf), {year: window})
        try:
            findings = gate.publish(levels, f"{path}/{year}", gate.benchmark_rules(asymmetric=ASYMMETRIC, short=SHORT))
        except gate.Rejected as rejected:
            findings = rejected.findings
        visible = table_exists(spark, f"{path}/{year}")
        rows += [(year, f.rule, name, int(value or 0), f.sound, visible) for f in findings for name, value in f.metrics.items()]
    return spark.createDataFrame(rows, "yr int, rule string, metric string, value long, sound boolean, visible boolean")


def _month_labor(spark, sf, **options):
    """Through the report's own option for benchmarks from January."""
    from catalog.quality_queries import report

    return report(spark, sf).labor(benchmark="month", **options)


IDX = ("idx_employees", "idx_hours", "idx_open")

QUERIES = {
    "labor_index_monthly": _monthly,
    "labor_index_relabelled": lambda s, d: _moved_monthly(s, d, presum=False),
    "labor_index_relabelled_presummed": lambda s, d: _moved_monthly(s, d, presum=True),
    "duplicate_benchmark_keys": lambda s, d: qa.duplicate_benchmark_keys(bm.weekday_benchmark(_moved(s, d), WINDOWS)),
    "labor_index_month_benchmark": lambda s, d: ix.monthly_index(
        ix.daily_index(_actuals(s, d), bm.month_benchmark(_actuals(s, d)))
    ),
    "labor_index_month_benchmark_by_industry": lambda s, d: _month_labor(s, d, by=["industry"]),
    "labor_index_month_benchmark_suppressed": lambda s, d: _month_labor(s, d, by=["industry"], min_locations=3),
    "large_moves_by_industry": lambda s, d: ix.large_moves(_monthly(s, d, by=["industry"]), by=["industry"]),
    "location_days": lambda s, d: doubles(
        bm.location_days(sample.shift_events(s, d)),
        "total_hours_scheduled",
        "total_hours_worked",
    ),
    "weekday_benchmark": lambda s, d: rounded(
        _bench(s, d), 6, "total_hours_scheduled_4weeks", "total_hours_worked_4weeks", *LEVELS
    ),
    "month_benchmark": lambda s, d: rounded(
        bm.month_benchmark(_actuals(s, d)), 6, "users_with_clock_in", "total_hours_worked"
    ),
    "daily_actuals": lambda s, d: doubles(_actuals(s, d), "total_hours_worked"),
    "daily_index": lambda s, d: rounded(_index(s, d), 9, *IDX),
    "daily_index_by_region": lambda s, d: rounded(
        ix.daily_index(
            ix.daily_actuals(
                ix.with_region(_events(s, d), sample.state_regions(s, d).filter(F.col("region") != "EUROPE")),
                LABOR_START,
                AS_OF,
                ["region"],
            ),
            _bench(s, d),
            ["region"],
        ),
        9,
        *IDX,
    ),
    "daily_index_by_industry_suppressed": lambda s, d: rounded(_index(s, d, ["industry"], min_locations=3), 9, *IDX),
    "labor_index_by_industry": lambda s, d: _monthly(s, d, by=["industry"]),
    "year_overlay": lambda s, d: ix.year_overlay(_monthly(s, d), "employees_working_pct", list(WINDOWS)),
    "large_moves": lambda s, d: ix.large_moves(_monthly(s, d)),
    "index_spot_check": lambda s, d: rounded(
        qa.spot_check(sample.shift_events(s, d, date(2001, 1, 1), date(2001, 12, 31)), _bench(s, d), 2001),
        9,
        "rel_employees_working",
        "rel_hours_worked",
        "rel_businesses_open",
    ),
    "benchmark_weekday_symmetry": lambda s, d: qa.weekday_symmetry(_bench(s, d)),
    "benchmark_days_with_data": lambda s, d: qa.days_with_data(_bench(s, d)),
    "benchmark_weekly": lambda s, d: doubles(
        bm.weekly_benchmark(
            sample.shift_events(s, d, date(2000, 1, 9), date(2000, 2, 5)), date(2000, 1, 9), date(2000, 2, 5)
        ),
        "total_hours_scheduled",
        "total_hours_worked",
    ),
    "january_team_sizes": lambda s, d: rounded(
        bm.team_sizes(
            sample.shift_events(s, d, date(2000, 1, 2), date(2000, 1, 29)), date(2000, 1, 2), date(2000, 1, 29)
        ),
        6,
        "avg_weekly_users",
    ),
    "location_date_grid": _grid,
    "benchmarks_published": _published,
    "benchmarks_gated": _gated,
}

# ---------------------------------------------------------------- SQL twins

_US = "state NOT IN ('Not USA', 'Unclassified')"
_SPAN = f"event_date BETWEEN DATE '{LABOR_START}' AND DATE '{AS_OF}'"


def _days(where: str, labels: str = "state, msa, industry, city, ", source: str = "shift_events") -> str:
    return f"""
    SELECT location_id, {labels}event_date, max(has_clock_in) AS has_clock_in,
           CAST(bool_or(unscheduled = 0) AS INTEGER) AS has_scheduled_shift,
           count(DISTINCT user_id) FILTER (has_clock_in = 1) AS users_with_clock_in,
           count(*) FILTER (has_clock_in = 1 AND unscheduled = 0) AS scheduled_clock_ins,
           count(DISTINCT user_id) FILTER (unscheduled = 0) AS users_with_scheduled_shifts,
           count(DISTINCT shift_id) FILTER (unscheduled = 0) AS total_scheduled_shifts,
           count(*) FILTER (has_clock_in = 1) AS total_clock_ins,
           coalesce(sum(hours_scheduled), 0) AS total_hours_scheduled,
           coalesce(sum(hours_worked) FILTER (has_clock_in = 1), 0) AS total_hours_worked
    FROM {source} {where} GROUP BY ALL"""


_HOURS_AS_DOUBLE = (
    "* REPLACE (CAST(total_hours_scheduled AS DOUBLE) AS total_hours_scheduled, "
    "CAST(total_hours_worked AS DOUBLE) AS total_hours_worked)"
)


_WIN = f"SELECT * FROM (VALUES {WINDOW_ROWS}) AS w(yr, lo, hi)"
# 28 days from the first Sunday on or after January 4, for every year of the events.
_EVERY_WIN = """
    SELECT yr, lo, CAST(lo + 27 AS DATE) AS hi FROM (
        SELECT yr, CAST(make_date(yr, 1, 4) + CAST((7 - dayofweek(make_date(yr, 1, 4))) % 7 AS INTEGER) AS DATE) AS lo
        FROM (SELECT unnest(range(min(year(event_date)), max(year(event_date)) + 1)) AS yr FROM shift_events))"""
_WEEKDAYS = [f"on_{code}" for code in range(7)]
_EACH_YEAR = f"""
    SELECT yr, count(*) AS rows, count(*) FILTER (days_with_data <> 4) AS short, min(days_with_data) AS least,
           max(days_with_data) AS most, count(*) FILTER (location_id IS NULL) AS nulls,
           {', '.join(f'count(*) FILTER (day_of_week = {code}) AS on_{code}' for code in range(7))}
    FROM totals GROUP BY yr"""
_JUDGED = f"""
    SELECT *, rows >= 1 AS ok_rows, nulls = 0 AS ok_nulls, short <= {SHORT}::DOUBLE * rows AS ok_days,
           greatest({', '.join(_WEEKDAYS)}) - least({', '.join(_WEEKDAYS)}) <= {ASYMMETRIC}::DOUBLE * greatest({', '.join(_WEEKDAYS)}) AS ok_week
    FROM each_year"""
_GATED = " UNION ALL ".join(
    f"""SELECT yr, '{rule}' AS rule, '{metric}' AS metric, CAST({metric} AS BIGINT) AS value, {sound} AS sound,
               ok_rows AND ok_nulls AND ok_days AND ok_week AS visible FROM judged"""
    for rule, sound, metrics in (
        ("row_count", "ok_rows", ["rows"]),
        ("weekday_symmetry", "ok_week", _WEEKDAYS),
        ("days_behind", "ok_days", ["rows", "short", "least", "most"]),
        ("null_share location_id", "ok_nulls", ["rows", "nulls"]),
    )
    for metric in metrics
)
_IN_WIN = "WHERE EXISTS (FROM win WHERE event_date BETWEEN lo AND hi)"
_WIN_DAYS = _days(_IN_WIN)
_BENCH = (
    """
    SELECT CAST(yr AS INTEGER) AS yr, location_id, state, msa, industry, city,
           CAST(dayofweek(event_date) AS INTEGER) AS day_of_week, count(*) AS days_with_data,
           nullif(count(*) FILTER (has_clock_in = 1), 0) AS denominator_clock_ins,
           nullif(count(*) FILTER (has_scheduled_shift = 1), 0) AS denominator_scheduled_shifts,
           nullif(count(*) FILTER (has_clock_in = 1 AND has_scheduled_shift = 1), 0)
               AS denominator_clock_ins_and_scheduled_shifts, """
    + ", ".join(f"CAST(sum({n}) AS {'DOUBLE' if 'hours' in n else 'BIGINT'}) AS {n}_4weeks" for n in LEVELS)
    + " FROM days JOIN win ON event_date BETWEEN lo AND hi GROUP BY ALL"
)
_BENCH_LEVELS = "SELECT *, " + ", ".join(
    f"{half_up(quotient(f'{n}_4weeks', bottom), 6)} AS {n}" for n, bottom in bm.LEVELS.items()
) + " FROM totals"
_RAW_LEVELS = (
    "SELECT yr, location_id, day_of_week, "
    f"{quotient('users_with_clock_in_4weeks', 'denominator_clock_ins')} AS bu, "
    f"{quotient('total_hours_worked_4weeks', 'denominator_clock_ins')} AS bh, "
    "denominator_clock_ins / 4.0 AS bo FROM totals"
)


def _act(extra: str = "", source: str = "shift_events", span: str = _SPAN) -> str:
    return f"""
    SELECT event_date, location_id, {extra}
           count(DISTINCT user_id) FILTER (has_clock_in = 1) AS users_with_clock_in,
           CAST(coalesce(sum(hours_worked) FILTER (has_clock_in = 1), 0) AS DOUBLE) AS total_hours_worked,
           max(has_clock_in) AS is_open
    FROM {source} WHERE {_US} AND {span} GROUP BY ALL"""


def _idx(extra: str = "", having: str = "", columns: str = "", digits: int | None = 9) -> str:
    def show(text: str) -> str:
        return text if digits is None else half_up(text, digits)

    return f"""
    SELECT event_date, CAST(a.yr AS INTEGER) AS yr, {extra}{columns}
           {show('sum(users_with_clock_in) / nullif(sum(bu), 0) - 1')} AS idx_employees,
           {show('sum(total_hours_worked) / nullif(sum(bh), 0) - 1')} AS idx_hours,
           {show('CAST(sum(is_open) AS DOUBLE) / nullif(sum(CAST(bo AS DOUBLE)), 0) - 1')} AS idx_open
    FROM (SELECT *, year(event_date) AS yr, dayofweek(event_date) AS day_of_week FROM act) a
    JOIN lv USING (location_id, yr, day_of_week) GROUP BY ALL {having}"""


_SUNDAY_12 = "CAST(make_date(year(event_date), month(event_date), 12) - CAST(dayofweek(make_date(year(event_date), month(event_date), 12)) AS INTEGER) AS DATE)"


def _months(extra: str = "") -> str:
    return f"""
    SELECT CAST(yr AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month, {extra}
           CAST({_SUNDAY_12} AS VARCHAR) AS reference_sunday,
           {half_up('avg(idx_employees) * 100', 2)} AS employees_working_pct,
           {half_up('avg(idx_hours) * 100', 2)} AS hours_worked_pct,
           {half_up('avg(idx_open) * 100', 2)} AS businesses_open_pct
    FROM idx WHERE event_date - {_SUNDAY_12} BETWEEN 0 AND 6 GROUP BY ALL"""


def _report(extra: str = "") -> str:
    prior = f"lag({{0}}) OVER (PARTITION BY {extra}year ORDER BY month)"
    parts = [
        f"{half_up(f'{source} - ' + prior.format(source), 2)} AS {name}" for name, source in ix.CHANGES.items()
    ]
    return f"SELECT *, {', '.join(parts)} FROM mon"


def _chain(levels: str = _RAW_LEVELS, **kw) -> dict:
    extra = kw.get("extra", "")
    return dict(
        win=_WIN, days=kw.get("days", _WIN_DAYS), totals=_BENCH, lv=levels, act=_act(extra), idx=_idx(extra, digits=None), mon=_months(extra)
    )


_MOVED = (
    "SELECT * REPLACE (CASE WHEN day(event_date) > 18 THEN upper(city) ELSE lower(city) END AS city) FROM shift_events"
)
_MOVED_DAYS = _days(_IN_WIN, source="moved")
_PRESUM = (
    "SELECT yr, location_id, day_of_week, sum(bu) AS bu, sum(bh) AS bh, sum(bo) AS bo "
    f"FROM ({_RAW_LEVELS}) GROUP BY ALL"
)
_MONTH_LEVELS = """
    SELECT year(event_date) AS yr, location_id, dayofweek(event_date) AS day_of_week,
           avg(users_with_clock_in) AS bu, avg(total_hours_worked) AS bh, count(*) / 4.0 AS bo
    FROM act WHERE month(event_date) = 1 GROUP BY ALL"""
_REGION = """
    SELECT e.* EXCLUDE (region), coalesce(g.region, 'Other') AS region
    FROM shift_events e LEFT JOIN (FROM geo WHERE region <> 'EUROPE') g USING (state)"""

SQL = {
    "labor_index_monthly": using("shift_events", _report(), **_chain()),
    "labor_index_relabelled": using("shift_events", _report(), moved=_MOVED, **_chain(days=_MOVED_DAYS)),
    "labor_index_relabelled_presummed": using(
        "shift_events", _report(), moved=_MOVED, **_chain(_PRESUM, days=_MOVED_DAYS)
    ),
    "duplicate_benchmark_keys": using(
        "shift_events",
        """SELECT yr, location_id, day_of_week, count(*) AS rows FROM totals GROUP BY ALL HAVING count(*) > 1""",
        moved=_MOVED,
        win=_WIN,
        days=_MOVED_DAYS,
        totals=_BENCH,
    ),
    "labor_index_month_benchmark": using(
        "shift_events", _report(), act=_act(), lv=_MONTH_LEVELS, idx=_idx(digits=None), mon=_months()
    ),
    "labor_index_month_benchmark_by_industry": using(
        "shift_events",
        _report("industry, "),
        act=_act("industry, "),
        lv=_MONTH_LEVELS,
        idx=_idx("industry, ", digits=None),
        mon=_months("industry, "),
    ),
    "labor_index_month_benchmark_suppressed": using(
        "shift_events",
        _report("industry, "),
        act=_act("industry, "),
        lv=_MONTH_LEVELS,
        idx=_idx("industry, ", "HAVING count(DISTINCT location_id) >= 3", digits=None),
        mon=_months("industry, "),
    ),
    "large_moves_by_industry": using(
        "shift_events",
        " UNION ALL ".join(
            f"SELECT industry, year, month, '{name}' AS metric, {name} AS change_ppt FROM rep WHERE abs({name}) > 3"
            for name in ix.CHANGES
        ),
        **_chain(extra="industry, "),
        rep=_report("industry, "),
    ),
    "location_days": using("shift_events", f"SELECT {_HOURS_AS_DOUBLE} FROM days", days=_days("")),
    "weekday_benchmark": using("shift_events", _BENCH_LEVELS, win=_WIN, days=_WIN_DAYS, totals=_BENCH),
    "month_benchmark": using(
        "shift_events",
        f"""SELECT CAST(year(event_date) AS INTEGER) AS yr, location_id,
                   CAST(dayofweek(event_date) AS INTEGER) AS day_of_week,
                   {half_up('avg(users_with_clock_in)', 6)} AS users_with_clock_in,
                   {half_up('avg(total_hours_worked)', 6)} AS total_hours_worked,
                   count(DISTINCT event_date) AS denominator_clock_ins
            FROM act WHERE month(event_date) = 1 GROUP BY ALL""",
        act=_act(),
    ),
    "daily_actuals": using("shift_events", "SELECT * FROM act", act=_act()),
    "daily_index": using("shift_events", _idx(), win=_WIN, days=_WIN_DAYS, totals=_BENCH, lv=_RAW_LEVELS, act=_act()),
    "daily_index_by_region": using(
        "shift_events",
        _idx("region, "),
        win=_WIN,
        days=_WIN_DAYS,
        totals=_BENCH,
        lv=_RAW_LEVELS,
        regional=_REGION,
        act=_act("region, ", "regional"),
    ),
    "daily_index_by_industry_suppressed": using(
        "shift_events",
        _idx(
            "industry, ",
            "HAVING count(DISTINCT location_id) >= 3",
            "count(DISTINCT location_id) AS locations, ",
        ),
        win=_WIN,
        days=_WIN_DAYS,
        totals=_BENCH,
        lv=_RAW_LEVELS,
        act=_act("industry, "),
    ),
    "labor_index_by_industry": using("shift_events", _report("industry, "), **_chain(extra="industry, ")),
    "year_overlay": using(
        "shift_events",
        "SELECT month, "
        + ", ".join(f'max(employees_working_pct) FILTER (year = {y}) AS "{y}"' for y in WINDOWS)
        + " FROM mon GROUP BY month",
        **_chain(),
    ),
    "large_moves": using(
        "shift_events",
        " UNION ALL ".join(
            f"SELECT year, month, '{name}' AS metric, {name} AS change_ppt FROM rep WHERE abs({name}) > 3"
            for name in ix.CHANGES
        ),
        **_chain(),
        rep=_report(),
    ),
    "index_spot_check": using(
        "shift_events",
        """SELECT event_date, idx_employees AS rel_employees_working, idx_hours AS rel_hours_worked,
                  idx_open AS rel_businesses_open FROM idx WHERE yr = 2001""",
        win=_WIN,
        days=_WIN_DAYS,
        totals=_BENCH,
        lv=_RAW_LEVELS,
        act=_act(span="year(event_date) = 2001"),
        idx=_idx(),
    ),
    "benchmark_weekday_symmetry": using(
        "shift_events",
        "SELECT yr, day_of_week, count(*) AS location_count FROM totals GROUP BY ALL",
        win=_WIN,
        days=_WIN_DAYS,
        totals=_BENCH,
    ),
    "benchmark_days_with_data": using(
        "shift_events",
        """SELECT yr, min(days_with_data) AS min_days, max(days_with_data) AS max_days,
                  count(*) FILTER (days_with_data <> 4) AS incomplete_rows FROM totals GROUP BY yr""",
        win=_WIN,
        days=_WIN_DAYS,
        totals=_BENCH,
    ),
    "benchmark_weekly": using(
        "shift_events",
        f"""SELECT location_id, state, msa, industry, city, {sunday('event_date')} AS week_start,
                   count(*) FILTER (has_clock_in = 1) AS open_days, """
        + ", ".join(f"CAST(sum({n}) AS {'DOUBLE' if 'hours' in n else 'BIGINT'}) AS {n}" for n in LEVELS)
        + " FROM days GROUP BY ALL",
        days=_days("WHERE event_date BETWEEN DATE '2000-01-09' AND DATE '2000-02-05'"),
    ),
    "benchmarks_published": using("shift_events", _BENCH_LEVELS, win=_EVERY_WIN, days=_WIN_DAYS, totals=_BENCH),
    "benchmarks_gated": using("shift_events", _GATED, win=_WIN, days=_WIN_DAYS, totals=_BENCH, each_year=_EACH_YEAR, judged=_JUDGED),
    "january_team_sizes": using(
        "shift_events",
        f"""SELECT location_id, {half_up('avg(n)', 6)} AS avg_weekly_users, count(*) AS active_weeks
            FROM (SELECT location_id, {sunday('event_date')} AS wk, count(DISTINCT user_id) AS n FROM shift_events
                  WHERE event_date BETWEEN DATE '2000-01-02' AND DATE '2000-01-29' AND has_clock_in = 1 GROUP BY ALL)
            GROUP BY location_id""",
    ),
    "location_date_grid": using(
        "shift_events locations",
        """SELECT CAST(d AS DATE) AS event_date, count(*) AS locations,
                  count(*) FILTER (has_clock_in = 1) AS open_locations,
                  CAST(sum(coalesce(users_with_clock_in, 0)) AS BIGINT) AS users
           FROM locations l CROSS JOIN (
               SELECT unnest(generate_series(min(event_date), max(event_date), INTERVAL 1 DAY)) AS d FROM shift_events)
           LEFT JOIN days ON days.location_id = l.location_id AND days.event_date = CAST(d AS DATE)
           GROUP BY ALL""",
        days=_days("", labels=""),
    ),
}
