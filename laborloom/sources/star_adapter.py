"""Labor tables derived from the sample star schema.

The sample data has orders and line items instead of shifts. A line item
becomes a shift, its order's customer the worker, five neighbouring suppliers
one location, so that locations grow with the data and a location keeps about
eight workers a week at any scale. All expressions are row-local; each has a
twin in ``catalog/adapter_sql.py`` for the result checks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.functions.labels import size_band
from laborloom.operators.classify import INDUSTRIES

# Fixed sample codes: fourteen known to the industry rules, two unknown.
NAICS = (
    "722511 312120 445110 999999 711110 812112 238220 541211 "
    "621111 721110 624410 100000 611110 813110 812320 493110"
).split()
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# Parameters the sample reports use.
AS_OF = date(2001, 10, 31)
BENCHMARK_YEARS = (1999, 2000, 2001)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple | list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations with their region.

    The nation table has 25 rows at every scale, so broadcasting it is bounded;
    a shuffle on 25 keys would be the one thing large data could not take.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    rows = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        key.cast("long").alias("nation_key"),
        F.when(key == 18, "Not USA").when(key == 19, "Unclassified").otherwise(F.col("n_name")).alias("state"),
        F.col("n_name").alias("state_name"),
        F.concat("n_name", F.lit(" MSA")).alias("msa"),
        F.col("r_name").alias("region"),
    )
    return F.broadcast(rows)


def _city(location: Column) -> Column:
    spelled = F.concat("region", F.lit(" City"))
    return F.when(location % 2 == 0, F.upper(spelled)).otherwise(F.lower(spelled))


def _location_created(location: Column) -> Column:
    return F.date_add(F.lit(date(1994, 6, 1)), (location % 40 * 30).cast("int"))


def _roster_size(location: Column) -> Column:
    return location * 37 % 120


def shift_rows(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None, parts: int | None = None
) -> DataFrame:
    """Line items with the ids and measures every labor table shares.

    ``start`` and ``end`` bound the ship date on the raw column, which reaches
    the parquet scan. With ``parts`` line items meet their orders in that many
    parts, instead of parts joined up to a size that says little about the
    memory of narrow rows.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ship = F.col("l_shipdate")
    if start is not None:
        lines = lines.filter(ship >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        lines = lines.filter(ship < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    if parts is not None:
        lines = lines.repartition(parts, "l_orderkey")
    location = F.expr("l_suppkey div 5")
    clock = F.when(F.col("l_returnflag") != "N", 1).otherwise(0)
    base = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        location.alias("location_id"),
        F.expr("l_suppkey div 15").alias("company_id"),
        F.to_date(ship).alias("event_date"),
        ship.cast("timestamp_ntz").alias("started_at"),
        F.col("o_custkey").alias("user_id"),
        F.expr(
            "((l_orderkey * 10 + l_linenumber) * 4000 + datediff(to_date(l_shipdate), DATE '1995-01-01'))"
            " * 1000000 + l_partkey"
        ).alias("shift_id"),
        (F.lit(4) + F.col("l_quantity") / 10).cast("decimal(8,4)").alias("hours_scheduled"),
        F.when(clock == 1, (F.col("l_quantity") / 5).cast("decimal(8,4)")).alias("hours_worked"),
        clock.alias("has_clock_in"),
        F.when((F.col("l_linenumber") == 7) & (clock == 1), 1).otherwise(0).alias("unscheduled"),
        F.when(F.col("l_discount") < 0.095, (F.lit(6) + F.col("l_tax") * 100).cast("decimal(8,4)")).alias(
            "hourly_wage_rate"
        ),
        F.col("l_linenumber").alias("line_no"),
    )
    return base


def shift_events(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None, parts: int | None = None
) -> DataFrame:
    rows = shift_rows(spark, sf_dir, start, end, parts).withColumn("nation_key", F.col("location_id") % 25)
    location = F.col("location_id")
    clocked = F.col("has_clock_in") == 1
    return rows.join(_geography(spark, sf_dir), "nation_key").select(
        "location_id",
        "company_id",
        "event_date",
        (F.col("started_at") - F.expr("INTERVAL 7 DAY")).alias("shift_created_at"),
        F.when(clocked, F.col("started_at")).alias("timecard_created_at"),
        (F.col("user_id") * 1000000 + location).alias("job_id"),
        "user_id",
        "shift_id",
        F.when(clocked, F.col("shift_id") + 1).alias("timecard_id"),
        "hours_scheduled",
        "hours_worked",
        "has_clock_in",
        "unscheduled",
        "hourly_wage_rate",
        (F.col("hours_worked") * F.col("hourly_wage_rate")).cast("decimal(8,4)").alias("total_wages_earned"),
        "state",
        "msa",
        _pick(SEGMENTS, location % 5).alias("industry"),
        _city(location).alias("city"),
        F.lpad((location % 99999).cast("string"), 5, "0").alias("zip"),
        F.lpad((location % 1000).cast("string"), 5, "0").alias("county_code"),
        "region",
    )


def naics_code(location: Column) -> Column:
    return F.when(location % 23 != 5, _pick(NAICS, location % 16))


def timeclock(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    location, user = F.col("location_id"), F.col("user_id")
    leaves = F.date_add(F.lit(date(1999, 1, 1)), (user % 700).cast("int"))
    return shift_events(spark, sf_dir, start, end).select(
        "*",
        F.when(user % 7 == 0, leaves).alias("archived_at"),
        F.when(location % 20 == 17, F.lit(date(2000, 6, 1))).alias("loc_archived_at"),
        naics_code(location).alias("naics_code"),
        size_band(_roster_size(location)).alias("employee_count"),
        F.datediff("event_date", _location_created(location)).alias("location_age"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = F.col("location_id")
    ids = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 5").alias("location_id")).distinct()
    ids = ids.withColumn("nation_key", location % 25)
    return ids.join(_geography(spark, sf_dir), "nation_key").select(
        "location_id",
        F.expr("location_id div 3").alias("company_id"),
        _location_created(location).alias("created_at"),
        F.when(location % 25 == 7, "Not USA").otherwise(F.col("state")).alias("state"),
        F.col("state").alias("state_cleaned"),
        "msa",
        _city(location).alias("city"),
        F.lpad((location % 99999).cast("string"), 5, "0").alias("zip"),
        naics_code(location).alias("naics_code"),
        _pick(SEGMENTS, location % 5).alias("business_type"),
        _pick(INDUSTRIES, location % 13).alias("business_type_new"),
        F.when(location % 31 != 11, F.concat(F.lit("Category "), (location % 29).cast("string"))).alias(
            "business_category_new"
        ),
        F.when(location % 20 == 17, F.lit(date(2000, 6, 1))).alias("archived_at"),
        "region",
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.col("company_id")
    ids = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 15").alias("company_id")).distinct()
    return ids.select(
        company,
        F.date_add(F.lit(date(1994, 1, 1)), (company % 8 * 400).cast("int")).alias("created_at"),
        F.when(company % 3 == 0, F.concat(F.lit("described "), (company % 4).cast("string"))).alias(
            "onboarding_business_description"
        ),
    )


def _roster_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One roster row per worker, location and calendar month with work.

    ``mix`` varies with every part of the key and decides the other columns.
    """
    month = (F.year("event_date") - 1995) * 12 + F.month("event_date")
    rows = shift_rows(spark, sf_dir).select("user_id", "location_id", month.alias("mo"), "event_date")
    mix = F.max(F.col("user_id") * 7 + F.col("location_id") * 3 + F.col("mo"))
    first = rows.groupBy("user_id", "location_id", "mo").agg(F.min("event_date").alias("created_at"), mix.alias("mix"))
    job = (F.col("user_id") * 1000000 + F.col("location_id")) * 1000 + F.col("mo")
    archived = F.when(F.col("mix") % 4 == 0, F.date_add("created_at", (F.col("mix") % 50 + 10).cast("int")))
    return first.select(job.alias("id"), "user_id", "location_id", "created_at", archived.alias("archived_at"), "mix")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roster_months(spark, sf_dir).select(
        "id",
        F.concat(F.lit("job-"), F.col("id").cast("string")).alias("uuid"),
        "user_id",
        "location_id",
        "created_at",
        "archived_at",
    )


def job_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of archived jobs: one, two, or one on another day."""
    mix = F.col("mix")
    archived = _roster_months(spark, sf_dir).filter(mix % 4 == 0)
    actors = F.array(
        F.lit("user 17"),
        F.lit("rake Businesses:archive_invoiced_company"),
        F.lit("LockJobWorker"),
        F.lit("manager 4"),
        F.lit(None).cast("string"),
    )
    copies = F.when(mix % 11 == 0, F.array(F.lit(0), F.lit(0))).otherwise(
        F.array(F.when(mix % 13 == 0, 1).otherwise(0))
    )
    actor = F.element_at(actors, (mix % 5 + 1).cast("int"))
    return archived.select(
        F.col("id").alias("item_id"), "archived_at", actor.alias("whodunnit"), F.explode(copies).alias("late")
    ).select("item_id", F.expr("date_add(archived_at, late)").alias("created_at"), "whodunnit")


def payroll_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.filter((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 40)).select(
        F.expr("l_suppkey div 5").alias("location_id"), F.to_date("l_shipdate").alias("payday")
    )


def raw_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled shifts before any enrichment; line 6 is an open shift."""
    hours = (F.col("hours_scheduled") * 3600).cast("long")
    return shift_rows(spark, sf_dir).select(
        F.col("shift_id").alias("id"),
        F.when(F.col("line_no") == 6, "OpenShift").otherwise("Job").alias("owner_type"),
        (F.col("user_id") * 1000000 + F.col("location_id")).alias("owner_id"),
        (F.col("line_no") % 3).cast("long").alias("role_id"),
        F.col("started_at").alias("start_at"),
        (F.col("started_at") + F.make_dt_interval(secs=hours.cast("decimal(18,6)"))).alias("end_at"),
        (F.col("started_at") - F.expr("INTERVAL 7 DAY")).alias("created_at"),
        "unscheduled",
    )


def raw_timecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (F.col("hours_worked") * 3600).cast("long")
    return (
        shift_rows(spark, sf_dir)
        .filter(F.col("has_clock_in") == 1)
        .select(
            (F.col("shift_id") + 1).alias("id"),
            "shift_id",
            F.col("started_at").alias("start_at"),
            (F.col("started_at") + F.make_dt_interval(secs=hours.cast("decimal(18,6)"))).alias("end_at"),
            F.col("started_at").alias("created_at"),
        )
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job row per worker and location, as the shift table refers to it."""
    return (
        shift_rows(spark, sf_dir)
        .select("user_id", "location_id")
        .distinct()
        .select(
            (F.col("user_id") * 1000000 + F.col("location_id")).alias("id"),
            "user_id",
            "location_id",
            F.when(
                F.col("user_id") % 7 == 0, F.date_add(F.lit(date(1999, 1, 1)), (F.col("user_id") % 700).cast("int"))
            ).alias("archived_at"),
        )
    )


def role_wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role pay of two thirds of the workers, for one role each."""
    worker = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(worker % 3 != 2).select(
        worker.alias("user_id"), (worker % 3).alias("role_id"), (F.lit(8) + worker % 120).cast("decimal(8,4)").alias("wage_rate")
    )


def default_wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(worker % 5 != 0).select(
        worker.alias("user_id"), (F.lit(7) + worker % 20).cast("decimal(8,4)").alias("wage_rate")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        worker.alias("user_id"),
        (worker % 20).alias("highest_level_location"),
        F.lit(date(1995, 1, 1)).cast("timestamp_ntz").alias("created_at"),
    )


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement flags per location from its suppliers' balances."""
    balance = F.col("s_acctbal")

    def any_of(condition: Column) -> Column:
        return F.max(condition.cast("int"))

    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.expr("s_suppkey div 5").alias("location_id"))
        .agg(
            any_of(balance > 8000).alias("engagement_boolean"),
            any_of(balance < 1000).alias("engagement_boolean_30d_ago"),
            any_of(balance > 9000).alias("scheduling_engaged_boolean"),
            any_of(balance < 500).alias("scheduling_engaged_boolean_30d_ago"),
            (F.max(balance) > 9500).alias("two_d_thirty_active_this_month"),
            (F.min(balance) < 0).alias("two_d_thirty_active_last_month"),
        )
    )


def location_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = F.col("location_id")
    return locations(spark, sf_dir).select("location_id", _roster_size(location).alias("employee_count"))


def state_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State to region labels, the lookup a caller supplies for regional cuts."""
    return _geography(spark, sf_dir).select("state", "region")


def label_maps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw to clean label lookups, each with gaps so that fallbacks occur."""
    geo = _geography(spark, sf_dir)
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("raw")).distinct()
    return {
        "state": geo.filter(F.col("nation_key") != 4).select(
            F.col("state").alias("raw"), F.concat(F.lit("S-"), "state").alias("label")
        ),
        "msa": geo.filter(F.col("nation_key") != 6).select(
            F.col("msa").alias("raw"), F.concat(F.lit("M-"), "msa").alias("label")
        ),
        "industry": segments.filter(F.col("raw") != "FURNITURE").select(
            "raw", F.initcap("raw").alias("label")
        ),
        "zip": locations(spark, sf_dir).filter(F.col("location_id") % 10 != 3).select(
            F.col("zip").alias("raw"), F.concat(F.lit("9"), F.substring("zip", 2, 4)).alias("label")
        ),
    }
