"""DuckDB twins of the sample adapter, as common table expressions."""

from __future__ import annotations

from laborloom.functions.labels import SIZE_BANDS
from laborloom.operators.classify import INDUSTRIES, NAICS_BY_INDUSTRY, UNMAPPED_INDUSTRY
from laborloom.sources.star_adapter import NAICS, SEGMENTS


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def half_up(value: str, digits: int) -> str:
    """Half-up rounding through DECIMAL, which both engines agree on."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def quotient(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


def rounded(top: str, bottom: str, digits: int = 2) -> str:
    return half_up(f"(coalesce(CAST({top} AS DOUBLE), 0) / nullif(CAST({bottom} AS DOUBLE), 0))", digits)


def sunday(day: str) -> str:
    return f"CAST({day} - CAST(dayofweek({day}) AS INTEGER) AS DATE)"


def monday(day: str) -> str:
    return f"CAST(date_trunc('week', {day}) AS DATE)"


def close(day: str) -> str:
    """Closing 27th: this month's up to day 27, else next month's."""
    return (
        f"CAST(CASE WHEN day({day}) <= 27 THEN make_date(year({day}), month({day}), 27) "
        f"ELSE make_date(year({day}), month({day}), 27) + INTERVAL 1 MONTH END AS DATE)"
    )


_NAICS = f"CASE WHEN {{loc}} % 23 <> 5 THEN list_extract({_list(NAICS)}, CAST({{loc}} % 16 + 1 AS INTEGER)) END"
_CITY = (
    "CASE WHEN {loc} % 2 = 0 THEN upper(g.region || ' City') "
    "ELSE lower(g.region || ' City') END"
)
_OPENED = "CAST(DATE '1994-06-01' + CAST({loc} % 40 * 30 AS INTEGER) AS DATE)"


def _band(count: str) -> str:
    whens = " ".join(f"WHEN {count} >= {floor} THEN '{label}'" for floor, label in reversed(SIZE_BANDS))
    return f"CASE WHEN {count} IS NULL OR {count} < 0 OR {count} >= 1000 THEN 'Unknown' {whens} END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "geo": (
        (),
        """
        SELECT n_nationkey AS nation_key,
               CASE n_nationkey WHEN 18 THEN 'Not USA' WHEN 19 THEN 'Unclassified' ELSE n_name END AS state,
               n_name || ' MSA' AS msa, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "rows_": (
        (),
        """
        SELECT l_suppkey // 5 AS location_id, l_suppkey // 15 AS company_id,
               CAST(l_shipdate AS DATE) AS event_date, CAST(l_shipdate AS TIMESTAMP) AS started_at,
               o_custkey AS user_id, l_linenumber AS line_no,
               ((l_orderkey * 10 + l_linenumber) * 4000 + (CAST(l_shipdate AS DATE) - DATE '1995-01-01')) * 1000000
                   + l_partkey AS shift_id,
               CAST(4 + l_quantity / 10 AS DECIMAL(18,4)) AS hours_scheduled,
               CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity / 5 AS DECIMAL(18,4)) END AS hours_worked,
               CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS has_clock_in,
               CASE WHEN l_returnflag <> 'N' AND l_linenumber = 7 THEN 1 ELSE 0 END AS unscheduled,
               CASE WHEN l_discount < 0.095 THEN CAST(6 + l_tax * 100 AS DECIMAL(18,4)) END AS hourly_wage_rate
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    ),
    "shift_events": (
        ("geo", "rows_"),
        f"""
        SELECT r.location_id, company_id, event_date, started_at - INTERVAL 7 DAY AS shift_created_at,
               CASE WHEN has_clock_in = 1 THEN started_at END AS timecard_created_at,
               user_id * 1000000 + r.location_id AS job_id, user_id, shift_id,
               CASE WHEN has_clock_in = 1 THEN shift_id + 1 END AS timecard_id,
               hours_scheduled, hours_worked, has_clock_in, unscheduled, hourly_wage_rate,
               CAST(hours_worked * hourly_wage_rate AS DECIMAL(18,4)) AS total_wages_earned,
               state, msa, list_extract({_list(SEGMENTS)}, CAST(r.location_id % 5 + 1 AS INTEGER)) AS industry,
               {_CITY.format(loc="r.location_id")} AS city,
               lpad(CAST(r.location_id % 99999 AS VARCHAR), 5, '0') AS zip,
               lpad(CAST(r.location_id % 1000 AS VARCHAR), 5, '0') AS county_code, g.region
        FROM rows_ r JOIN geo g ON g.nation_key = r.location_id % 25""",
    ),
    "timeclock": (
        ("shift_events",),
        f"""
        SELECT *,
               CASE WHEN user_id % 7 = 0 THEN CAST(DATE '1999-01-01' + CAST(user_id % 700 AS INTEGER) AS DATE) END AS archived_at,
               CASE WHEN location_id % 20 = 17 THEN DATE '2000-06-01' END AS loc_archived_at,
               {_NAICS.format(loc="location_id")} AS naics_code,
               {_band("(location_id * 37 % 120)")} AS employee_count,
               event_date - {_OPENED.format(loc="location_id")} AS location_age
        FROM shift_events""",
    ),
    "locations": (
        ("geo",),
        f"""
        SELECT s.location_id, s.location_id // 3 AS company_id, {_OPENED.format(loc="s.location_id")} AS created_at,
               CASE WHEN s.location_id % 25 = 7 THEN 'Not USA' ELSE state END AS state, state AS state_cleaned, msa,
               {_CITY.format(loc="s.location_id")} AS city,
               lpad(CAST(s.location_id % 99999 AS VARCHAR), 5, '0') AS zip,
               {_NAICS.format(loc="s.location_id")} AS naics_code,
               list_extract({_list(SEGMENTS)}, CAST(s.location_id % 5 + 1 AS INTEGER)) AS business_type,
               list_extract({_list(INDUSTRIES)}, CAST(s.location_id % 13 + 1 AS INTEGER)) AS business_type_new,
               CASE WHEN s.location_id % 31 <> 11 THEN 'Category ' || CAST(s.location_id % 29 AS VARCHAR) END
                   AS business_category_new,
               CASE WHEN s.location_id % 20 = 17 THEN DATE '2000-06-01' END AS archived_at, g.region
        FROM (SELECT DISTINCT s_suppkey // 5 AS location_id FROM supplier) s
        JOIN geo g ON g.nation_key = s.location_id % 25""",
    ),
    "companies": (
        (),
        """
        SELECT DISTINCT s_suppkey // 15 AS company_id,
               CAST(DATE '1994-01-01' + CAST(s_suppkey // 15 % 8 * 400 AS INTEGER) AS DATE) AS created_at,
               CASE WHEN s_suppkey // 15 % 3 = 0 THEN 'described ' || CAST(s_suppkey // 15 % 4 AS VARCHAR) END
                   AS onboarding_business_description
        FROM supplier""",
    ),
    "jobs": (
        ("rows_",),
        """
        SELECT *, CASE WHEN mix % 4 = 0 THEN CAST(created_at + CAST(mix % 50 + 10 AS INTEGER) AS DATE) END AS archived_at
        FROM (SELECT *, user_id * 7 + location_id * 3 + id % 1000 AS mix FROM (SELECT (user_id * 1000000 + location_id) * 1000
                         + (year(event_date) - 1995) * 12 + month(event_date) AS id,
                     user_id, location_id, min(event_date) AS created_at
              FROM rows_ GROUP BY 1, 2, 3))""",
    ),
    "job_versions": (
        ("jobs",),
        """
        SELECT id AS item_id,
               CASE mix % 5 WHEN 0 THEN 'user 17' WHEN 1 THEN 'rake Businesses:archive_invoiced_company'
                           WHEN 2 THEN 'LockJobWorker' WHEN 3 THEN 'manager 4' END AS whodunnit,
               CASE WHEN mix % 13 = 0 AND mix % 11 <> 0 THEN CAST(archived_at + 1 AS DATE) ELSE archived_at END AS created_at
        FROM jobs, range(2) AS copy(n)
        WHERE archived_at IS NOT NULL AND (n = 0 OR mix % 11 = 0)""",
    ),
    "payroll_runs": (
        (),
        """
        SELECT l_suppkey // 5 AS location_id, CAST(l_shipdate AS DATE) AS payday
        FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40""",
    ),
    "naics_rules": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{code}', '{label}')" for label, codes in NAICS_BY_INDUSTRY.items() for code in codes.split())
        + ") AS t(code, label)",
    ),
    "engagement": (
        (),
        """
        SELECT s_suppkey // 5 AS location_id,
               CAST(bool_or(s_acctbal > 8000) AS INTEGER) AS engagement_boolean,
               CAST(bool_or(s_acctbal < 1000) AS INTEGER) AS engagement_boolean_30d_ago,
               CAST(bool_or(s_acctbal > 9000) AS INTEGER) AS scheduling_engaged_boolean,
               CAST(bool_or(s_acctbal < 500) AS INTEGER) AS scheduling_engaged_boolean_30d_ago,
               bool_or(s_acctbal > 9500) AS two_d_thirty_active_this_month,
               bool_or(s_acctbal < 0) AS two_d_thirty_active_last_month
        FROM supplier GROUP BY 1""",
    ),
}
UNMAPPED = UNMAPPED_INDUSTRY


def using(tables: str, body: str, **more: str) -> str:
    """SQL text with the named adapter tables (and those they need) up front.

    ``more`` adds further CTEs in order before the body, which is the SELECT.
    """
    order: list[str] = []

    def need(name: str) -> None:
        for parent in CTES[name][0]:
            need(parent)
        if name not in order:
            order.append(name)

    for name in tables.split():
        need(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
