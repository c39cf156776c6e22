"""Base table builds and classification."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.adapter_sql import UNMAPPED, _band, using
from catalog.common import doubles, rounded
from laborloom.functions import labels
from laborloom.functions.labels import age_years, size_band
from laborloom.operators import base, classify
from laborloom.operators.reuse import computed_once
from laborloom.sources import star_adapter as sample
from laborloom.sources.scan import between_dates, date_span, union_years

HORIZON = date(1996, 1, 1)


def _built(spark, sf):
    return base.build_shift_events(
        sample.raw_shifts(spark, sf),
        sample.roster(spark, sf),
        sample.raw_timecards(spark, sf),
        sample.locations(spark, sf),
        sample.companies(spark, sf),
        sample.label_maps(spark, sf),
        sample.role_wages(spark, sf),
        sample.default_wages(spark, sf),
        HORIZON,
    )


def _enriched(spark, sf):
    return base.build_timeclock(
        _built(spark, sf),
        sample.users(spark, sf),
        sample.roster(spark, sf),
        sample.locations(spark, sf),
        sample.engagement(spark, sf),
        sample.location_sizes(spark, sf),
    )


def _profile(spark, sf):
    """Whole built table reduced to a monthly fingerprint per label set."""
    built = _built(spark, sf)
    return doubles(
        built.groupBy(F.trunc("event_date", "month").alias("month"), "state", "msa", "industry", "county_code").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("has_clock_in").alias("clock_ins"),
            F.sum("unscheduled").alias("unscheduled"),
            F.sum("hours_scheduled").alias("hours_scheduled"),
            F.sum("hours_worked").alias("hours_worked"),
            F.count("hourly_wage_rate").alias("rated_rows"),
            F.sum("hourly_wage_rate").alias("rates"),
            F.sum("total_wages_earned").alias("wages"),
            F.count("timecard_created_at").alias("cards"),
            F.max(F.to_date("shift_created_at")).alias("latest_created"),
        ),
        "hours_scheduled",
        "hours_worked",
        "rates",
        "wages",
    )


def _timeclock_rows(spark, sf):
    return doubles(
        _enriched(spark, sf).select(
            "shift_id",
            "user_id",
            "location_id",
            "event_date",
            "archived_at",
            "loc_archived_at",
            "naics_code",
            *base.ENGAGEMENT_FLAGS,
            "employee_count",
            "location_age",
            F.to_date("user_created_at").alias("user_created"),
            "hours_worked",
        ),
        "hours_worked",
    )


def _primary_rows(spark, sf):
    """Rows kept by the rule; counted per worker and location before the join."""
    counts = sample.shift_events(spark, sf).groupBy("location_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    kept = base.primary_location_only(counts, sample.users(spark, sf))
    return kept.groupBy("location_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("users"))


def _by_location(spark, sf):
    """Shifts per industry; counted per location before the join."""
    counts = sample.shift_events(spark, sf).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))
    labelled = classify.by_location(counts, sample.locations(spark, sf))
    return labelled.groupBy("broad_industry", "industry_subcategory").agg(F.sum("n").alias("shifts"))


def _size_bands(spark, sf):
    counts = sample.shift_events(spark, sf).groupBy("location_id").agg(F.countDistinct("user_id").alias("employees"))
    return counts.select("location_id", "employees", size_band("employees").alias("employee_count"))


def _ages(spark, sf):
    clock = sample.timeclock(spark, sf)
    per_place = clock.groupBy("location_id").agg(F.max("location_age").alias("age_days"))
    return rounded(per_place.withColumn("age_years", age_years("age_days")), 6, "age_years")


def _inline_rule(spark, sf):
    """Rows and locations that pass each form of the ad hoc qualification rule."""
    clock = sample.timeclock(spark, sf)
    general, turnover = labels.inline_qualified(), labels.inline_qualified(turnover=True)
    return clock.groupBy(F.year("event_date").alias("yr"), "location_id").agg(
        F.count(F.when(general, 1)).alias("qualified_rows"), F.count(F.when(turnover, 1)).alias("turnover_rows")
    )


def _naics(spark, sf):
    clock = sample.timeclock(spark, sf).groupBy("naics_code").agg(F.count(F.lit(1)).alias("shifts"))
    return classify.by_naics(clock)


def _union_years(spark, sf):
    """Every year the events have, as if each were a table of its own; the years read events that are joined once."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = computed_once(sample.shift_events(spark, sf, parts=parts).select("location_id", "event_date"), "dated-events")
    first, last = date_span(events, "event_date")
    years = {
        year: between_dates(events, "event_date", date(year, 1, 1), date(year, 12, 31))
        for year in range(first.year, last.year + 1)
    }
    return union_years(years).groupBy("yr", "location_id").agg(F.count(F.lit(1)).alias("shifts"))


def _engagement(spark, sf):
    change = base.engagement_change(sample.engagement(spark, sf)).withColumnRenamed("engagement_change", "core")
    scheduling = base.engagement_change(sample.engagement(spark, sf), "scheduling_engaged_boolean")
    monthly = base.engagement_change(
        sample.engagement(spark, sf), "two_d_thirty_active_this_month", "two_d_thirty_active_last_month"
    )
    return (
        change.join(scheduling.withColumnRenamed("engagement_change", "scheduling"), "location_id")
        .join(monthly.withColumnRenamed("engagement_change", "two_day"), "location_id")
    )


QUERIES = {
    "shift_events_build": _profile,
    "timeclock_build": _timeclock_rows,
    "primary_location_rows": _primary_rows,
    "employee_size_bands": _size_bands,
    "location_age": _ages,
    "inline_qualification": _inline_rule,
    "engagement_change": _engagement,
    "industry_by_location": _by_location,
    "industry_by_naics": _naics,
    "industry_hierarchy": lambda s, d: classify.hierarchy(sample.locations(s, d)),
    "ambiguous_naics": lambda s, d: classify.ambiguous_codes(sample.locations(s, d)),
    "employees_by_industry": lambda s, d: classify.employees_by_industry(sample.timeclock(s, d), sample.locations(s, d)),
    "yearly_tables_union": _union_years,
}

# ---------------------------------------------------------------- SQL twins

_CLEAN = """
    SELECT l.location_id, l.company_id, city, zip,
           CASE WHEN l.state = 'NATION_4' THEN 'Unclassified' ELSE 'S-' || l.state END AS state,
           CASE WHEN l.msa = 'NATION_6 MSA' THEN 'All other' ELSE 'M-' || l.msa END AS msa,
           CASE WHEN coalesce(onboarding_business_description, business_type) IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY')
                THEN upper(business_type[1]) || lower(business_type[2:]) ELSE 'Unknown' END AS industry,
           CASE WHEN l.location_id % 10 <> 3 THEN '9' || zip[2:] END AS county_code
    FROM locations l LEFT JOIN companies c USING (company_id)"""
_BUILT = f"""
    SELECT r.*, c.state, c.msa, c.industry, c.county_code,
           CASE WHEN rate < 100 THEN rate END AS wage
    FROM (SELECT *, CASE WHEN user_id % 3 <> 2 AND line_no % 3 = user_id % 3 THEN CAST(8 + user_id % 120 AS DECIMAL(18,4))
                         WHEN user_id % 5 <> 0 THEN CAST(7 + user_id % 20 AS DECIMAL(18,4)) END AS rate
          FROM rows_ WHERE line_no <> 6 AND event_date > DATE '{HORIZON}') r
    JOIN clean c USING (location_id)"""

SQL = {
    "shift_events_build": using(
        "locations companies rows_",
        """SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, state, msa, industry, county_code,
                  count(*) AS rows, CAST(sum(has_clock_in) AS BIGINT) AS clock_ins,
                  CAST(sum(unscheduled) AS BIGINT) AS unscheduled,
                  CAST(sum(hours_scheduled) AS DOUBLE) AS hours_scheduled, CAST(sum(hours_worked) AS DOUBLE) AS hours_worked,
                  count(wage) AS rated_rows, CAST(sum(wage) AS DOUBLE) AS rates,
                  CAST(sum(CAST(hours_worked * wage AS DECIMAL(18,4))) AS DOUBLE) AS wages,
                  count(*) FILTER (has_clock_in = 1) AS cards, CAST(max(event_date) - 7 AS DATE) AS latest_created
           FROM built GROUP BY ALL""",
        clean=_CLEAN,
        built=_BUILT,
    ),
    "timeclock_build": using(
        "locations companies rows_ engagement",
        f"""SELECT shift_id, user_id, b.location_id, event_date,
                   CASE WHEN user_id % 7 = 0 THEN CAST(DATE '1999-01-01' + CAST(user_id % 700 AS INTEGER) AS DATE) END AS archived_at,
                   l.archived_at AS loc_archived_at, naics_code, {', '.join(base.ENGAGEMENT_FLAGS)},
                   {_band('(b.location_id * 37 % 120)')} AS employee_count, CAST(event_date - l.created_at AS INTEGER) AS location_age,
                   DATE '1995-01-01' AS user_created, CAST(hours_worked AS DOUBLE) AS hours_worked
            FROM built b JOIN locations l ON l.location_id = b.location_id JOIN engagement g ON g.location_id = b.location_id
            WHERE user_id % 20 = b.location_id""",
        clean=_CLEAN,
        built=_BUILT,
    ),
    "primary_location_rows": using(
        "shift_events",
        """SELECT location_id, count(*) AS rows, count(DISTINCT user_id) AS users FROM shift_events
           WHERE location_id = user_id % 20 GROUP BY ALL""",
    ),
    "employee_size_bands": using(
        "shift_events",
        f"""SELECT location_id, employees, {_band('employees')} AS employee_count
            FROM (SELECT location_id, count(DISTINCT user_id) AS employees FROM shift_events GROUP BY ALL)""",
    ),
    "location_age": using(
        "timeclock",
        """SELECT location_id, CAST(max(location_age) AS INTEGER) AS age_days,
                  CAST(round(CAST(max(location_age) / 365.25 AS DECIMAL(38,12)), 6) AS DOUBLE) AS age_years
           FROM timeclock GROUP BY ALL""",
    ),
    "inline_qualification": using(
        "timeclock",
        """SELECT CAST(year(event_date) AS INTEGER) AS yr, location_id,
                  count(*) FILTER (ok AND employee_count IN ('5–9 employees', '10–19 employees', '20–49 employees', '50–99 employees')) AS qualified_rows,
                  count(*) FILTER (ok AND employee_count IN ('10–19 employees', '20–49 employees', '50–99 employees')) AS turnover_rows
           FROM (SELECT *, location_age >= 84 AND loc_archived_at IS NULL AS ok FROM timeclock) GROUP BY ALL""",
    ),
    "engagement_change": using(
        "engagement",
        "SELECT location_id, "
        + ", ".join(
            f"""CASE WHEN {now} AND NOT {was} THEN 'newly engaged' WHEN {was} AND NOT {now} THEN 'churned'
                     WHEN {now} THEN 'retained' ELSE 'inactive' END AS {name}"""
            for name, now, was in (
                ("core", "(engagement_boolean = 1)", "(engagement_boolean_30d_ago = 1)"),
                ("scheduling", "(scheduling_engaged_boolean = 1)", "(scheduling_engaged_boolean_30d_ago = 1)"),
                ("two_day", "two_d_thirty_active_this_month", "two_d_thirty_active_last_month"),
            )
        )
        + " FROM engagement",
    ),
    "industry_by_location": using(
        "shift_events locations",
        """SELECT business_type_new AS broad_industry, business_category_new AS industry_subcategory, count(*) AS shifts
           FROM shift_events JOIN locations l USING (location_id)
           WHERE state_cleaned NOT IN ('Not USA', 'Unclassified') GROUP BY ALL""",
    ),
    "industry_by_naics": using(
        "timeclock naics_rules",
        f"""SELECT naics_code, count(*) AS shifts, coalesce(any_value(label), '{UNMAPPED}') AS broad_industry
            FROM timeclock LEFT JOIN naics_rules ON code = naics_code GROUP BY naics_code""",
    ),
    "industry_hierarchy": using(
        "locations",
        """SELECT DISTINCT business_category_new AS industry_subcategory, business_type_new AS broad_industry, naics_code
           FROM locations""",
    ),
    "ambiguous_naics": using(
        "locations",
        """SELECT naics_code, count(DISTINCT (business_category_new, business_type_new)) AS placements FROM locations
           WHERE naics_code IS NOT NULL GROUP BY ALL HAVING count(DISTINCT (business_category_new, business_type_new)) > 1""",
    ),
    "employees_by_industry": using(
        "timeclock locations",
        """SELECT event_date, business_type_new AS broad_industry, business_category_new AS industry_subcategory,
                  count(DISTINCT user_id) AS employees_working
           FROM timeclock JOIN locations l USING (location_id)
           WHERE has_clock_in = 1 AND state_cleaned NOT IN ('Not USA', 'Unclassified') GROUP BY ALL""",
    ),
    "yearly_tables_union": using(
        "shift_events",
        """SELECT CAST(year(event_date) AS INTEGER) AS yr, location_id, count(*) AS shifts FROM shift_events
           GROUP BY ALL""",
    ),
}
