"""Matched-cohort wages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.adapter_sql import close, half_up, quotient, using
from catalog.common import ANCHOR, rounded
from laborloom.operators import wages
from laborloom.operators.reuse import shared_path
from laborloom.sources import extracts
from laborloom.sources import star_adapter as sample

START = date(1999, 1, 1)
BASE = (1999, 1)
# The published cuts keep the legacy industry.
PUBLISHED = {"industry": "business_type", "state": "state_cleaned", "msa": "msa"}
CANONICAL = {"industry": "business_type_new", "state": "state_cleaned", "msa": "msa"}


def _pay(spark, sf, segments=None):
    cohort = wages.payroll_cohort(sample.payroll_runs(spark, sf), ANCHOR)
    if segments is not None:
        cohort = wages.with_segments(cohort, sample.locations(spark, sf), segments)
    return wages.job_pay(sample.shift_events(spark, sf, START, ANCHOR.report_end), cohort, START, ANCHOR.report_end)


def _cut(by=None, min_jobs=wages.MIN_JOBS):
    def query(spark, sf):
        return rounded(wages.wage_rates(_pay(spark, sf), sample.locations(spark, sf), by, min_jobs), 6, "wage_rate")

    return query


def _cuts(spark, sf, segments=wages.LEGACY_SEGMENTS):
    return wages.wage_cuts(_pay(spark, sf, segments))


def _national(spark, sf):
    return wages.wage_rates(_pay(spark, sf))


def _job_rates(spark, sf):
    pay = _pay(spark, sf)
    return rounded(pay.withColumn("wage_rate", wages.ratio("wages", "hours")), 6, "wages", "hours", "wage_rate")


EXTRACTED = {"segmented_by": "string", "segment": "string", "period_end": "date", "wage_rate": "double", "sample_size_jobs": "long"}


def _rolling(spark, sf):
    cohort = wages.with_segments(wages.rolling_cohort(sample.payroll_runs(spark, sf)), sample.locations(spark, sf), wages.LEGACY_SEGMENTS)
    return wages.rolling_wages(wages.rolling_pay(sample.shift_events(spark, sf, START, ANCHOR.report_end), cohort, START, ANCHOR.report_end))


QUERIES = {
    "payroll_cohort": lambda s, d: wages.payroll_cohort(sample.payroll_runs(s, d), ANCHOR),
    "job_wage_rates": _job_rates,
    "wages_national": lambda s, d: rounded(wages.against_base(_national(s, d), *BASE), 6, "wage_rate"),
    "wages_by_industry": _cut("business_type"),
    "wages_by_canonical_industry": _cut("business_type_new"),
    "wages_by_state": _cut("state_cleaned"),
    "wages_by_msa": _cut("msa"),
    "wages_by_msa_unsuppressed": _cut("msa", None),
    "wages_all_cuts": lambda s, d: rounded(
        wages.against_base(_cuts(s, d), *BASE, by=["segmented_by", "segment"]), 6, "wage_rate"
    ),
    "wages_month_on_month": lambda s, d: rounded(
        wages.month_on_month(_cuts(s, d, CANONICAL), ["segmented_by", "segment"]), 6, "wage_rate", "mom_pct_change"
    ),
    "wages_year_on_year": lambda s, d: rounded(
        wages.year_on_year(_cuts(s, d), ["segmented_by", "segment"]), 6, "wage_rate", "yoy_pct_change"
    ),
}
def _extract(spark, sf):
    """The wage series written as numbered files in order, and read back with each row's place."""
    path = shared_path(spark, "wage-extract")
    if path is None:
        raise ValueError("set spark.checkpoint.dir: the query goes through written files")
    series = rounded(_cuts(spark, sf), 6, "wage_rate").select(*EXTRACTED)
    extracts.write_extract(series, path, ["segmented_by", "segment", "period_end"], files=4)
    sound = extracts.check_extract(spark, path, list(EXTRACTED)).agg(F.bool_and("sound").alias("sound"))
    schema = ", ".join(f"{name} {kind}" for name, kind in EXTRACTED.items())
    return extracts.read_extract(spark, path, schema).join(F.broadcast(sound))  # one row


QUERIES |= {
    "wages_extract": _extract,
    "wages_rolling_cohort": lambda s, d: rounded(_rolling(s, d), 6, "wage_rate", "wage_rate_year_ago", "yoy_pct_change"),
    "rolling_cohort_sizes": lambda s, d: wages.rolling_cohort(sample.payroll_runs(s, d))
    .select(F.explode("months").alias("month_number"))
    .groupBy("month_number")
    .agg(F.count(F.lit(1)).alias("locations")),
}

# ---------------------------------------------------------------- SQL twins

_END = ANCHOR.report_end
_COHORT = """
    SELECT location_id FROM payroll_runs
    WHERE (year(payday), month(payday)) IN ((%d, %d), (%d, %d))
    GROUP BY location_id HAVING count(DISTINCT year(payday)) = 2""" % (*ANCHOR.cohort_start, *ANCHOR.cohort_end)
_DATED = f"""
    SELECT e.location_id, job_id, total_wages_earned AS w, hours_worked AS h, {close('CAST(timecard_created_at AS DATE)')} AS period_end
    FROM shift_events e WHERE CAST(timecard_created_at AS DATE) BETWEEN DATE '{START}' AND DATE '{_END}'
      AND e.location_id IN (FROM cohort)"""
_POOLED = f"SELECT period_end, job_id, {quotient('sum(w)', 'sum(h)')} AS rate FROM dated GROUP BY ALL"
_PLACED = f"""
    SELECT l.business_type, l.business_type_new, l.state_cleaned, l.msa, period_end, job_id, location_id,
           {quotient('sum(w)', 'sum(h)')} AS rate
    FROM dated JOIN locations l USING (location_id) WHERE l.state NOT IN ('Not USA', 'Unclassified') GROUP BY ALL"""
_BASE_CTES = dict(cohort=_COHORT, dated=_DATED)
_KEEP = "HAVING count(DISTINCT job_id) > 20"


def _mean(select: str, source: str, having: str = _KEEP, digits: int | None = 6) -> str:
    rate = "avg(rate)" if digits is None else half_up("avg(rate)", digits)
    return f"""SELECT {select} period_end, {rate} AS wage_rate, count(DISTINCT job_id) AS sample_size_jobs
               FROM {source} GROUP BY ALL {having}"""


def _cut_sql(column: str, having: str = _KEEP) -> str:
    return using("shift_events locations payroll_runs", _mean(f"{column},", "placed", having), **_BASE_CTES, placed=_PLACED)


def _union(segments: dict[str, str]) -> str:
    parts = [_mean("'national' AS segmented_by, 'national' AS segment,", "pooled", digits=None)]
    parts += [_mean(f"'{name}' AS segmented_by, {column} AS segment,", "placed", digits=None) for name, column in segments.items()]
    return " UNION ALL ".join(parts)


def _series_sql(segments: dict[str, str], extra: str) -> str:
    return using(
        "shift_events locations payroll_runs",
        f"""SELECT segmented_by, segment, period_end, {half_up('wage_rate', 6)} AS wage_rate, sample_size_jobs, {extra}
            FROM cuts WINDOW s AS (PARTITION BY segmented_by, segment ORDER BY period_end)""",
        **_BASE_CTES,
        pooled=_POOLED,
        placed=_PLACED,
        cuts=_union(segments),
    )


def _above_base(partition: str = "") -> str:
    base = f"max(wage_rate) FILTER (period_end = DATE '1999-01-27') OVER ({partition})"
    return half_up(f"(wage_rate - {base}) / {base} * 100", 2) + " AS pct_above_base"


_MEMBER = """
    SELECT a.location_id, a.m FROM ran a JOIN ran b ON a.location_id = b.location_id AND b.m = a.m - 12"""
_RAN = "SELECT DISTINCT location_id, year(payday) * 12 + month(payday) AS m FROM payroll_runs"
_ALL_PAY = f"""
    SELECT location_id, job_id, total_wages_earned AS w, hours_worked AS h, {close('CAST(timecard_created_at AS DATE)')} AS closed
    FROM shift_events WHERE CAST(timecard_created_at AS DATE) BETWEEN DATE '{START}' AND DATE '{_END}'"""


def _side(side: str, months: int) -> str:
    """Pay of the cohort of the month that lies ``months`` after it."""
    later = f"CAST(closed + INTERVAL {months} MONTH AS DATE)"
    return f"""
        SELECT p.*, {later} AS period_end, '{side}' AS side FROM all_pay p
        JOIN member USING (location_id) WHERE m = year({later}) * 12 + month({later}) AND {later} <= DATE '{_END}'"""


def _rolling_sql() -> str:
    rate = quotient("sum(w)", "sum(h)")
    parts = [
        f"""SELECT 'national' AS segmented_by, 'national' AS segment, period_end, side, NULL AS place, job_id, {rate} AS rate
            FROM sides GROUP BY period_end, side, job_id"""
    ]
    for name, column in PUBLISHED.items():
        parts.append(
            f"""SELECT '{name}', {column}, period_end, side, s.location_id, job_id, {rate} FROM sides s JOIN locations l USING (location_id)
                WHERE l.state NOT IN ('Not USA', 'Unclassified') GROUP BY {column}, period_end, side, s.location_id, job_id"""
        )
    means = """
        SELECT segmented_by, segment, period_end, side, avg(rate) AS rate, count(DISTINCT job_id) AS jobs FROM rates
        GROUP BY ALL HAVING count(DISTINCT job_id) > 20"""
    body = f"""
        SELECT n.segmented_by, n.segment, n.period_end, {half_up('n.rate', 6)} AS wage_rate, n.jobs AS sample_size_jobs,
               {half_up('b.rate', 6)} AS wage_rate_year_ago, {half_up('n.rate / b.rate - 1', 6)} AS yoy_pct_change
        FROM means n LEFT JOIN means b ON b.side = 'year_ago' AND b.segmented_by = n.segmented_by
             AND b.segment IS NOT DISTINCT FROM n.segment AND b.period_end = n.period_end
        WHERE n.side = 'now'"""
    return using(
        "shift_events locations payroll_runs",
        body,
        ran=_RAN,
        member=_MEMBER,
        all_pay=_ALL_PAY,
        sides=f"{_side('now', 0)} UNION ALL {_side('year_ago', 12)}",
        rates=" UNION ALL ".join(parts),
        means=means,
    )


_YEAR_AGO = """(SELECT max(b.wage_rate) FROM cuts b WHERE b.segmented_by = cuts.segmented_by
    AND b.segment = cuts.segment AND b.period_end = CAST(cuts.period_end - INTERVAL 1 YEAR AS DATE))"""

SQL = {
    "payroll_cohort": using("payroll_runs", "SELECT location_id FROM cohort", cohort=_COHORT),
    "job_wage_rates": using(
        "shift_events payroll_runs",
        f"""SELECT location_id, period_end, job_id, CAST(sum(w) AS DOUBLE) AS wages, CAST(sum(h) AS DOUBLE) AS hours,
                   {half_up(quotient('sum(w)', 'sum(h)'), 6)} AS wage_rate
            FROM dated GROUP BY ALL""",
        **_BASE_CTES,
    ),
    "wages_national": using(
        "shift_events payroll_runs",
        f"SELECT period_end, {half_up('wage_rate', 6)} AS wage_rate, sample_size_jobs, {_above_base()} FROM nat",
        **_BASE_CTES,
        pooled=_POOLED,
        nat=_mean("", "pooled", digits=None),
    ),
    "wages_by_industry": _cut_sql("business_type"),
    "wages_by_canonical_industry": _cut_sql("business_type_new"),
    "wages_by_state": _cut_sql("state_cleaned"),
    "wages_by_msa": _cut_sql("msa"),
    "wages_by_msa_unsuppressed": _cut_sql("msa", ""),
    "wages_all_cuts": _series_sql(PUBLISHED, _above_base("PARTITION BY segmented_by, segment")),
    "wages_month_on_month": _series_sql(
        CANONICAL, half_up("wage_rate / lag(wage_rate) OVER s - 1", 6) + " AS mom_pct_change"
    ),
    "wages_year_on_year": _series_sql(
        PUBLISHED, half_up(f"wage_rate / {_YEAR_AGO} - 1", 6) + " AS yoy_pct_change"
    ),
    "wages_rolling_cohort": _rolling_sql(),
    "rolling_cohort_sizes": using(
        "payroll_runs",
        "SELECT CAST(m AS INTEGER) AS month_number, count(*) AS locations FROM member GROUP BY ALL",
        ran=_RAN,
        member=_MEMBER,
    ),
    "wages_extract": using(
        "shift_events locations payroll_runs",
        f"""SELECT segmented_by, segment, period_end, {half_up('wage_rate', 6)} AS wage_rate, sample_size_jobs,
                   row_number() OVER (ORDER BY segmented_by, segment NULLS FIRST, period_end) AS place, true AS sound
            FROM cuts""",
        **_BASE_CTES,
        pooled=_POOLED,
        placed=_PLACED,
        cuts=_union(PUBLISHED),
    ),
}
