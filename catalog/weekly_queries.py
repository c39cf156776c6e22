"""Weekly qualification and the weekly workforce table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from catalog.adapter_sql import half_up, monday, quotient, rounded as ratio_sql, sunday, using
from catalog.common import AS_OF, rounded
from laborloom.operators import impact, qualify, weekly
from laborloom.operators.reuse import shared_path
from laborloom.periods import EventScope, week_floor
from laborloom.plans.weekly_store import WeeklyStore
from laborloom.sources import star_adapter as sample
from laborloom.sources.scan import between_dates, date_span

FLAGS = [rule.column for rule in qualify.RULES]
CHANGE_METRICS = ("hours_worked", "total_shifts", "active_users")
FLAG_VIEW = ["location_id", "week_start", "weekly_employees", "employees_12w_avg", "weeks_active_52w", "wage_coverage_ratio"]


def _table(spark, sf, **options):
    return weekly.weekly_table(sample.timeclock(spark, sf), AS_OF, **options)


def _flags(spark, sf, **options):
    flags = qualify.location_flags(sample.timeclock(spark, sf), **options).select(*FLAG_VIEW, "archived_this_week", *FLAGS)
    return rounded(flags, 9, "employees_12w_avg", "wage_coverage_ratio")


def _relabelled(spark, sf):
    """Every third location moves to another state in the middle of 1998."""
    events = sample.timeclock(spark, sf)
    moved = (F.col("location_id") % 3 == 0) & (F.col("event_date") >= F.lit("1998-06-24").cast("date"))
    return events.withColumn("state", F.when(moved, F.concat(F.lit("NEW "), "state")).otherwise(F.col("state")))


def _refreshed(spark, sf):
    """The stored table, built as it was four weeks earlier and then given the weeks since."""
    path = shared_path(spark, "weekly-store")
    if path is None:
        raise ValueError("set spark.checkpoint.dir: the query goes through written tables")
    events, earlier = sample.timeclock(spark, sf), AS_OF - timedelta(days=28)
    early = events.filter(F.col("event_date") <= F.lit(earlier))
    WeeklyStore(spark, path, earlier, files_per_partition=1).build(early)
    store = WeeklyStore(spark, path, AS_OF, files_per_partition=1)
    _, last = date_span(between_dates(events, "event_date", earlier), "event_date") or (None, earlier)
    store.refresh(events, [earlier + timedelta(days=k) for k in range((last - earlier).days + 1)])
    return store.report()


QUERIES = {
    "location_qualification": _flags,
    "location_qualification_calendar": lambda s, d: _flags(s, d, frame="calendar"),
    "weekly_table": _table,
    "weekly_table_monday": lambda s, d: _table(s, d, first="monday"),
    "weekly_table_by_state": lambda s, d: _table(s, d, by=["state"]),
    "weekly_table_by_state_relabelled": lambda s, d: weekly.weekly_table(_relabelled(s, d), AS_OF, by=["state"]),
    "weekly_table_ten_years": lambda s, d: _table(s, d, periods_back=520).select("period_start", "active_location_count"),
    "weekly_table_by_msa": lambda s, d: _table(s, d, by=["msa"]),
    "weekly_table_by_city": lambda s, d: _table(s, d, by=["city"]),
    "weekly_table_by_city_suppressed": lambda s, d: _table(s, d, by=["city"], min_locations=2),
    "weekly_table_all_cuts": lambda s, d: _table(s, d, cuts=weekly.CUTS),
    "weekly_table_refreshed": _refreshed,
    "weekly_table_four_week_lookback": lambda s, d: _table(s, d, lookback_weeks=4),
    "weekly_table_literal_survival": lambda s, d: _table(s, d, literal_survival=True),
    "weekly_table_one_msa": lambda s, d: weekly.weekly_table(
        impact.in_scope(sample.timeclock(s, d), EventScope(None, None, msa="NATION_1 MSA")), AS_OF
    ),
    "survival_rate": lambda s, d: weekly.survival_rate(_table(s, d)),
    "weekly_change": lambda s, d: weekly.weekly_change(_table(s, d), CHANGE_METRICS),
    "weekly_change_by_state": lambda s, d: weekly.weekly_change(_table(s, d, by=["state"]), CHANGE_METRICS, ["state"]),
}

# ---------------------------------------------------------------- SQL twins


def _flag_ctes(week, label: str = "", frame: str = "rows") -> dict[str, str]:
    if frame == "rows":
        size = "avg(emp) OVER (h ROWS 11 PRECEDING)"
        weeks = "count(*) OVER (h ROWS 51 PRECEDING)"
    else:
        size = "CAST(sum(emp) OVER (h RANGE 77 PRECEDING) AS DOUBLE) / 12"
        weeks = "count(*) OVER (h RANGE 357 PRECEDING)"
    return {
        "wk": f"""
            SELECT *, {week('event_date')} AS w, {week('loc_archived_at')} AS closed_w,
                   total_wages_earned IS NOT NULL AND hours_worked IS NOT NULL
                       AND hourly_wage_rate >= 7.25 AND hourly_wage_rate <= 100 AS payable
            FROM timeclock""",
        "lw": f"""
            SELECT location_id, w, {f"max(struct_pack(d := event_date, k := {label})).k AS {label}, " if label else ""}
                   count(DISTINCT user_id) AS emp,
                   {quotient('sum(hours_worked) FILTER (hourly_wage_rate IS NOT NULL)', 'sum(hours_worked)')} AS cover,
                   coalesce(bool_or(closed_w = w), false) AS closing
            FROM wk GROUP BY ALL""",
        "hist": f"""
            SELECT *, {size} AS size, {weeks} AS n FROM lw
            WINDOW h AS (PARTITION BY location_id ORDER BY w - DATE '1970-01-01')""",
        "q": """
            SELECT *, coalesce(size >= 5 AND size <= 100 AND n >= 12 AND NOT closing, false) AS qj,
                   coalesce(size >= 10 AND size <= 100 AND n >= 12 AND NOT closing, false) AS qt,
                   coalesce(size >= 5 AND size <= 100 AND n >= 12 AND NOT closing AND cover > 0.5, false) AS qw,
                   coalesce(size >= 5 AND size <= 100 AND n >= 26 AND NOT closing, false) AS qo
            FROM hist""",
    }


def _flags_sql(frame: str = "rows") -> str:
    body = f"""
        SELECT location_id, w AS week_start, emp AS weekly_employees, {half_up('size', 9)} AS employees_12w_avg,
               n AS weeks_active_52w, {half_up('cover', 9)} AS wage_coverage_ratio,
               CAST(closing AS INTEGER) AS archived_this_week,
               CAST(qj AS INTEGER) AS qualified_for_jobs, CAST(qt AS INTEGER) AS qualified_for_turnover,
               CAST(qj AS INTEGER) AS qualified_for_hours, CAST(qw AS INTEGER) AS qualified_for_wages,
               CAST(qo AS INTEGER) AS qualified_for_outlook
        FROM q"""
    return using("timeclock", body, **_flag_ctes(sunday, frame=frame))


def _table_ctes(by: str = "", first: str = "sunday", lookback: int = 1, literal: bool = False, back: int = 260) -> dict[str, str]:
    """The weekly table from set-based definitions: EXISTS for flows, joins for outlook."""
    week = sunday if first == "sunday" else monday
    key = f"{by}, " if by else ""
    lo = week_floor(AS_OF - timedelta(days=7 * back), first)
    hi = week_floor(AS_OF, first)
    hi = hi if hi + timedelta(days=6) <= AS_OF else hi - timedelta(days=7)
    same = "b.user_id = p.user_id AND b.location_id = p.location_id"
    here = "b.location_id = a.location_id"
    spine = f"BETWEEN DATE '{lo}' AND DATE '{hi}'"
    using_q = "USING (location_id, w)"
    ctes = _flag_ctes(week, by)
    ctes |= {
        "e": f"SELECT wk.* {f'EXCLUDE ({by}), q.{by}' if by else ''}, qj, qt, qw, qo FROM wk JOIN q {using_q}",
        "tot": f"""
            SELECT {key}w, count(DISTINCT location_id) FILTER (qj) AS act,
                   count(DISTINCT user_id) FILTER (qt AND shift_id IS NOT NULL) AS usr,
                   sum(hours_worked) FILTER (qj) AS hrs,
                   sum(hours_worked) FILTER (qw AND hourly_wage_rate IS NOT NULL) AS hrw,
                   sum(total_wages_earned) FILTER (qw AND payable) AS pay,
                   sum(hours_worked) FILTER (qw AND payable) AS payh,
                   count(DISTINCT user_id) FILTER (qw AND payable) AS payu,
                   count(shift_id) FILTER (qo) AS sh,
                   count(DISTINCT location_id) FILTER (qo AND shift_id IS NOT NULL) AS lc
            FROM e GROUP BY ALL""",
        "pairs": f"""
            SELECT DISTINCT {key}user_id, location_id, w FROM e
            WHERE qj AND shift_id IS NOT NULL AND user_id IS NOT NULL AND w {spine}""",
        "fresh": f"""
            SELECT * FROM pairs p WHERE NOT EXISTS (
                FROM pairs b WHERE {same} AND b.w < p.w AND b.w >= p.w - {7 * lookback})""",
        "added": f"SELECT {key}w, count(DISTINCT user_id) AS ja FROM fresh GROUP BY ALL",
        "newh": f"""
            SELECT {key}w, sum(hours_worked) AS hnew
            FROM e JOIN fresh USING ({key}user_id, location_id, w) WHERE shift_id IS NOT NULL GROUP BY ALL""",
        "gone": f"""
            SELECT {key}CAST(w + 7 AS DATE) AS w, count(DISTINCT user_id) AS jr FROM pairs p
            WHERE NOT EXISTS (FROM pairs b WHERE {same} AND b.w = p.w + 7) GROUP BY ALL""",
        "debut": f"""
            SELECT {f'm.k AS {by}, ' if by else ''}m.w AS w, count(*) AS nu
            FROM (SELECT user_id, min(struct_pack(w := w{f', k := {by}' if by else ''})) AS m
                  FROM e WHERE qt AND user_id IS NOT NULL GROUP BY user_id) GROUP BY ALL""",
        "left_": f"""
            SELECT {f'q.{by}, ' if by else ''}m.w, count(DISTINCT m.user_id) AS ar
            FROM (SELECT location_id, user_id, {week('archived_at')} AS w FROM wk
                  WHERE archived_at < DATE '{AS_OF}') m
            JOIN q {using_q} WHERE qt GROUP BY ALL""",
        "ahead": f"""
            SELECT {f'a.{by}, ' if by else ''}a.w, count(*) AS fs, count(DISTINCT a.location_id) AS fl
            FROM q a JOIN wk b ON {here} AND b.w > a.w AND b.w <= a.w + 28 AND b.shift_id IS NOT NULL
            WHERE a.qo GROUP BY ALL""",
        "surv": f"""
            SELECT {f'a.{by}, ' if by else ''}CAST(a.w + 364 AS DATE) AS w, count(*) AS base, count(b.w) AS sv
            FROM q a {'' if literal else 'LEFT'} JOIN q b ON {here} AND b.w = a.w + 364 AND b.qo
            WHERE a.qo AND a.w {spine} GROUP BY ALL""",
        "roll": f"""
            SELECT {key}w, CAST(sum(usr) OVER (PARTITION BY {by or '1'} ORDER BY w ROWS 11 PRECEDING) AS DOUBLE) / 12 AS avg12
            FROM tot WHERE w {spine}""",
    }
    parts = ["tot", "added", "newh", "gone", "debut", "left_", "ahead", "surv", "roll"]
    if by:
        ctes["keys"] = " UNION ".join(f"SELECT {key}w FROM {part}" for part in parts)
    else:
        ctes["keys"] = f"SELECT CAST(d AS DATE) AS w FROM generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 7 DAY) AS g(d)"
    joins = " ".join(f"LEFT JOIN {part} USING ({key}w)" for part in parts)
    ctes["wide"] = f"""
        SELECT * FROM keys {joins}
        WHERE w {spine} AND w >= DATE '{AS_OF - timedelta(days=7 * back)}'"""

    def n(name: str) -> str:
        return f"coalesce({name}, 0)"

    def money(name: str) -> str:
        return half_up(f"coalesce({name}, 0)", 2)

    flow = f"({n('ja')} - {n('jr')})"
    churn = f"({n('nu')} + {n('ar')})"
    ctes["report"] = f"""
        SELECT {key}w AS period_start, CAST(w + 6 AS DATE) AS period_end,
               act AS active_location_count, usr AS active_users, {half_up('avg12', 2)} AS avg_active_users_12w,
               {n('sh')} AS total_shifts, {n('ja')} AS jobs_added, {n('jr')} AS jobs_archived,
               {n('nu')} AS users_added, {n('ar')} AS users_archived,
               {money('hrs')} AS hours_worked, {money('hrw')} AS hours_worked_with_wage, {money('hnew')} AS hours_new_jobs,
               {n('fs')} AS future_shifts, {n('fl')} AS future_locs,
               {half_up(quotient('pay', 'payh'), 2)} AS avg_nominal_wage,
               {half_up(quotient('pay', 'payu'), 2)} AS avg_weekly_pay,
               {n('sv')} AS surviving_businesses_this_week, {n('base')} AS surviving_businesses_last_52w,
               {ratio_sql('hrs', 'act')} AS avg_hours_worked_per_loc, {ratio_sql('hrw', 'act')} AS avg_hours_wage_per_loc,
               {ratio_sql('ja', 'act')} AS avg_jobs_added_per_loc, {ratio_sql('jr', 'act')} AS avg_jobs_archived_per_loc,
               {ratio_sql(flow, 'act')} AS avg_net_jobs_added_per_loc, {ratio_sql('sh', 'act')} AS shifts_per_loc,
               {ratio_sql('hrs', 'usr')} AS hours_worked_per_user, {ratio_sql('hrs', 'sh')} AS hours_worked_per_shift,
               {ratio_sql('usr', 'act')} AS employees_per_loc, {ratio_sql('fs', 'sh')} AS future_shift_growth,
               {ratio_sql('fl', 'lc')} AS future_loc_growth, {ratio_sql('ar', 'avg12')} AS turnover_rate,
               {ratio_sql('nu', 'avg12')} AS hire_rate, {ratio_sql(churn, 'avg12')} AS turnover_volatility_idx
        FROM wide"""
    return ctes


def _table_sql(body: str = "SELECT * FROM report", **options) -> str:
    return using("timeclock", body, **_table_ctes(**options))


def _all_cuts_sql(cuts: dict[str, str | None]) -> str:
    """The tables of all cuts, each from its own definitions, one below the other."""
    parts = []
    for name, column in cuts.items():
        ctes = ", ".join(f"{cte} AS ({text})" for cte, text in _table_ctes(by=column or "").items())
        shown = f"{column} AS segment, * EXCLUDE ({column})" if column else f"'{name}' AS segment, *"
        parts.append(f"SELECT '{name}' AS segmented_by, {shown} FROM (WITH {ctes} SELECT * FROM report)")
    return using("timeclock", " UNION ALL BY NAME ".join(parts))


def _change_sql(by: str = "") -> str:
    key = f"{by}, " if by else ""
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY period_start)"
    parts = [
        f"CAST({m} AS {'DOUBLE' if m == 'hours_worked' else 'BIGINT'}) AS {m}, "
        + half_up(f"(CAST({m} AS DOUBLE) - lag({m}) {over}) / nullif(CAST(lag({m}) {over} AS DOUBLE), 0)", 4)
        + f" AS {m}_change"
        for m in CHANGE_METRICS
    ]
    return _table_sql(f"SELECT {key}period_start, {', '.join(parts)} FROM report", by=by)


SQL = {
    "location_qualification": _flags_sql(),
    "location_qualification_calendar": _flags_sql("calendar"),
    "weekly_table": _table_sql(),
    "weekly_table_monday": _table_sql(first="monday"),
    "weekly_table_by_state": _table_sql(by="state"),
    "weekly_table_by_state_relabelled": using(
        "timeclock",
        "SELECT * FROM report",
        relabelled="""
            SELECT * REPLACE (CASE WHEN location_id % 3 = 0 AND event_date >= DATE '1998-06-24' THEN 'NEW ' || state
                              ELSE state END AS state) FROM timeclock""",
        **{name: text.replace("FROM timeclock", "FROM relabelled") for name, text in _table_ctes(by="state").items()},
    ),
    "weekly_table_ten_years": _table_sql(
        "SELECT period_start, active_location_count FROM report", back=520
    ),
    "weekly_table_by_msa": _table_sql(by="msa"),
    "weekly_table_by_city": _table_sql(by="city"),
    "weekly_table_by_city_suppressed": _table_sql("SELECT * FROM report WHERE active_location_count >= 2", by="city"),
    "weekly_table_all_cuts": _all_cuts_sql(weekly.CUTS),
    "weekly_table_refreshed": _table_sql(),
    "weekly_table_four_week_lookback": _table_sql(lookback=4),
    "weekly_table_literal_survival": _table_sql(literal=True),
    "weekly_table_one_msa": using(
        "timeclock",
        "SELECT * FROM report",
        **{
            name: text.replace("FROM timeclock", "FROM timeclock WHERE msa = 'NATION_1 MSA'")
            for name, text in _table_ctes().items()
        },
    ),
    "survival_rate": _table_sql(
        "SELECT period_start, period_end, surviving_businesses_this_week, surviving_businesses_last_52w, "
        + ratio_sql("surviving_businesses_this_week", "surviving_businesses_last_52w", 4)
        + " AS survival_rate FROM report"
    ),
    "weekly_change": _change_sql(),
    "weekly_change_by_state": _change_sql("state"),
}
