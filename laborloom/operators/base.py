"""Base tables: shift events and the enriched timeclock table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborloom.functions.labels import INDUSTRY_FALLBACK, MSA_FALLBACK, STATE_FALLBACK, size_band

# First event day is the one after this; rates from here up are dropped.
HORIZON = date(2016, 1, 1)
RATE_CEILING = 100


def hours_between(df: DataFrame, start: str, end: str) -> Column:
    """Elapsed hours in whole seconds as an exact decimal; NULL when either is.

    Timestamps without a zone are subtracted as they stand, so that the session
    zone's clock changes do not enter; zoned ones are compared as instants.
    """
    if df.schema[start].dataType.typeName() == "timestamp_ntz":
        gap = (F.col(end) - F.col(start)).cast("interval second")
        seconds = gap.cast("decimal(18,6)").cast("long")
    else:
        micros = F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))
        seconds = (micros / F.lit(1000000).cast("decimal(10,0)")).cast("long")
    return (seconds / F.lit(3600).cast("decimal(10,0)")).cast("decimal(18,4)")


def standard_label(df: DataFrame, raw: str, lookup: DataFrame, name: str, fallback: str | None) -> DataFrame:
    """Replace a raw label by its standard one, with a fallback for gaps.

    ``lookup`` has columns (raw, label). Of several labels the smallest counts,
    so that rows are neither multiplied nor labelled by chance; whether it is
    broadcast is left to the size check.
    """
    entries = lookup.groupBy(F.col("raw").alias("_raw")).agg(F.min("label").alias("_label"))
    label = F.coalesce("_label", F.lit(fallback)) if fallback is not None else F.col("_label")
    joined = df.join(entries, F.col(raw) == F.col("_raw"), "left").withColumn(name, label)
    return joined.drop("_raw", "_label")


def location_labels(locations: DataFrame, companies: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Clean labels per location.

    Lookups run on the location table, not on the events: labels are location
    attributes, so events need one join instead of five.
    """
    described = companies.select("company_id", "onboarding_business_description")
    base = locations.join(described, "company_id", "left").select(
        "location_id",
        "company_id",
        F.col("state").alias("raw_state"),
        F.col("msa").alias("raw_msa"),
        F.coalesce("onboarding_business_description", "business_type").alias("raw_industry"),
        "city",
        "zip",
    )
    labelled = standard_label(base, "raw_state", maps["state"], "state", STATE_FALLBACK)
    labelled = standard_label(labelled, "raw_msa", maps["msa"], "msa", MSA_FALLBACK)
    labelled = standard_label(labelled, "raw_industry", maps["industry"], "industry", INDUSTRY_FALLBACK)
    labelled = standard_label(labelled, "zip", maps["zip"], "county_code", None)
    return labelled.drop("raw_state", "raw_msa", "raw_industry")


def build_shift_events(
    shifts: DataFrame,
    jobs: DataFrame,
    timecards: DataFrame,
    locations: DataFrame,
    companies: DataFrame,
    maps: dict[str, DataFrame],
    role_wages: DataFrame,
    default_wages: DataFrame,
    horizon: date = HORIZON,
) -> DataFrame:
    """One row per assigned shift with its timecard, wage and labels.

    Shifts of owner type 'Job' join their roster row; a missing timecard means
    no clock-in. The rate is the role wage or the default wage, and is dropped
    when implausibly high. The horizon is a range on ``start_at`` so it reaches
    the scan.
    """
    assigned = shifts.filter((F.col("owner_type") == "Job") & (F.col("start_at") >= F.date_add(F.lit(horizon), 1)))
    shift = assigned.select(
        F.col("id").alias("shift_id"),
        F.col("owner_id").alias("job_id"),
        "role_id",
        F.col("start_at").alias("shift_start"),
        F.col("created_at").alias("shift_created_at"),
        hours_between(assigned, "start_at", "end_at").alias("hours_scheduled"),
        F.coalesce(F.col("unscheduled").cast("int"), F.lit(0)).alias("unscheduled"),
    )
    card = timecards.select(
        "shift_id",
        F.col("id").alias("timecard_id"),
        F.col("created_at").alias("timecard_created_at"),
        hours_between(timecards, "start_at", "end_at").alias("hours_worked"),
    )
    # Everything that depends on the roster row alone is attached to the roster,
    # which leaves the shifts three shuffles: timecard, roster row, role wage.
    by_default = default_wages.select("user_id", F.col("wage_rate").alias("default_rate"))
    job = (
        jobs.select(F.col("id").alias("job_id"), "user_id", "location_id")
        .join(by_default, "user_id", "left")
        .join(location_labels(locations, companies, maps), "location_id", "left")
    )
    by_role = role_wages.select("user_id", "role_id", F.col("wage_rate").alias("role_rate"))
    rate = F.coalesce("role_rate", "default_rate")
    return (
        shift.join(card, "shift_id", "left")
        .join(job, "job_id")
        .join(by_role, ["user_id", "role_id"], "left")
        .withColumn("hourly_wage_rate", F.when(rate < RATE_CEILING, rate))
        .select(
            "location_id",
            "company_id",
            F.to_date("shift_start").alias("event_date"),
            "shift_created_at",
            "timecard_created_at",
            "job_id",
            "user_id",
            "shift_id",
            "timecard_id",
            "hours_scheduled",
            "hours_worked",
            F.col("timecard_id").isNotNull().cast("int").alias("has_clock_in"),
            "unscheduled",
            "hourly_wage_rate",
            (F.col("hours_worked") * F.col("hourly_wage_rate")).cast("decimal(18,4)").alias("total_wages_earned"),
            F.coalesce("state", F.lit(STATE_FALLBACK)).alias("state"),
            F.coalesce("msa", F.lit(MSA_FALLBACK)).alias("msa"),
            F.coalesce("industry", F.lit(INDUSTRY_FALLBACK)).alias("industry"),
            "city",
            "zip",
            "county_code",
        )
    )


def primary_location_only(events: DataFrame, users: DataFrame) -> DataFrame:
    """Keep a worker's rows at their highest-level location."""
    home = users.select("user_id", F.col("highest_level_location").alias("_home"))
    return events.join(home, "user_id").filter(F.col("location_id") == F.col("_home")).drop("_home")


ENGAGEMENT_FLAGS = (
    "engagement_boolean",
    "engagement_boolean_30d_ago",
    "scheduling_engaged_boolean",
    "scheduling_engaged_boolean_30d_ago",
    "two_d_thirty_active_this_month",
    "two_d_thirty_active_last_month",
)


def build_timeclock(
    events: DataFrame,
    users: DataFrame,
    jobs: DataFrame,
    locations: DataFrame,
    engagement: DataFrame,
    location_sizes: DataFrame,
) -> DataFrame:
    """Shift events at primary locations with archive dates, flags, size and age.

    ``location_sizes`` has an employee count per location, and per day when it
    carries an ``event_date`` column.
    """
    home = users.select(
        "user_id", F.col("highest_level_location").alias("_home"), F.col("created_at").alias("user_created_at")
    )
    place = locations.select(
        "location_id", F.col("archived_at").alias("loc_archived_at"), "naics_code", F.col("created_at").alias("_opened")
    ).join(engagement.select("location_id", *ENGAGEMENT_FLAGS), "location_id", "left")
    dated = "event_date" in location_sizes.columns
    size_key = ["location_id", "event_date"] if dated else ["location_id"]
    sizes = location_sizes.select(*size_key, F.col("employee_count").alias("_employees"))
    if not dated:
        place = place.join(sizes, size_key, "left")
    # The primary-location rule and all attributes are settled on the roster,
    # so events meet one join that also drops their secondary-location rows.
    roster = (
        jobs.select(F.col("id").alias("job_id"), "user_id", "location_id", "archived_at")
        .join(home, "user_id")
        .filter(F.col("location_id") == F.col("_home"))
        .join(place, "location_id", "left")
        .drop("user_id", "location_id", "_home")
    )
    joined = events.join(roster, "job_id")
    if dated:
        joined = joined.join(sizes, size_key, "left")
    return (
        joined.withColumn("employee_count", size_band("_employees"))
        .withColumn("location_age", F.datediff("event_date", F.col("_opened").cast("date")))
        .drop("_opened", "_employees")
    )


def engagement_change(locations_with_flags: DataFrame, now: str = "engagement_boolean", before: str | None = None) -> DataFrame:
    """Classify each location as newly engaged, churned, retained or inactive."""
    before = before or f"{now}_30d_ago"
    on = F.coalesce(F.col(now).cast("int"), F.lit(0)) == 1
    was = F.coalesce(F.col(before).cast("int"), F.lit(0)) == 1
    change = (
        F.when(on & ~was, "newly engaged").when(~on & was, "churned").when(on & was, "retained").otherwise("inactive")
    )
    return locations_with_flags.select("location_id", change.alias("engagement_change"))
