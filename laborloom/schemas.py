"""Table contracts: the columns each operator family relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG, INT, TEXT, DAY, TS, NUM, FLAG = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.DateType(),
    T.TimestampNTZType(),
    T.DecimalType(18, 4),
    T.BooleanType(),
)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SHIFT_EVENTS = _schema(
    ("location_id", LONG),
    ("company_id", LONG),
    ("event_date", DAY),
    ("shift_created_at", TS),
    ("timecard_created_at", TS),
    ("job_id", LONG),
    ("user_id", LONG),
    ("shift_id", LONG),
    ("timecard_id", LONG),
    ("hours_scheduled", NUM),
    ("hours_worked", NUM),
    ("has_clock_in", INT),
    ("unscheduled", INT),
    ("hourly_wage_rate", NUM),
    ("total_wages_earned", NUM),
    ("state", TEXT),
    ("msa", TEXT),
    ("industry", TEXT),
    ("city", TEXT),
    ("zip", TEXT),
    ("county_code", TEXT),
)

TIMECLOCK = T.StructType(
    SHIFT_EVENTS.fields
    + _schema(
        ("archived_at", DAY),
        ("loc_archived_at", DAY),
        ("user_created_at", TS),
        ("naics_code", TEXT),
        ("engagement_boolean", INT),
        ("engagement_boolean_30d_ago", INT),
        ("scheduling_engaged_boolean", INT),
        ("scheduling_engaged_boolean_30d_ago", INT),
        ("two_d_thirty_active_this_month", FLAG),
        ("two_d_thirty_active_last_month", FLAG),
        ("employee_count", TEXT),
        ("location_age", INT),
    ).fields
)

LOCATIONS = _schema(
    ("location_id", LONG),
    ("company_id", LONG),
    ("created_at", DAY),
    ("state", TEXT),
    ("state_cleaned", TEXT),
    ("msa", TEXT),
    ("city", TEXT),
    ("zip", TEXT),
    ("naics_code", TEXT),
    ("business_type", TEXT),
    ("business_type_new", TEXT),
    ("business_category_new", TEXT),
)

COMPANIES = _schema(("company_id", LONG), ("created_at", DAY), ("onboarding_business_description", TEXT))

JOBS = _schema(
    ("id", LONG),
    ("uuid", TEXT),
    ("user_id", LONG),
    ("location_id", LONG),
    ("created_at", DAY),
    ("archived_at", DAY),
)

JOB_VERSIONS = _schema(("item_id", LONG), ("created_at", DAY), ("whodunnit", TEXT))

PAYROLL_RUNS = _schema(("location_id", LONG), ("payday", DAY))

BENCHMARKS = _schema(
    ("yr", INT),
    ("location_id", LONG),
    ("state", TEXT),
    ("msa", TEXT),
    ("industry", TEXT),
    ("city", TEXT),
    ("day_of_week", INT),
    ("days_with_data", LONG),
    ("denominator_clock_ins", LONG),
    ("denominator_scheduled_shifts", LONG),
    ("denominator_clock_ins_and_scheduled_shifts", LONG),
    ("users_with_clock_in_4weeks", LONG),
    ("scheduled_clock_ins_4weeks", LONG),
    ("users_with_scheduled_shifts_4weeks", LONG),
    ("total_scheduled_shifts_4weeks", LONG),
    ("total_clock_ins_4weeks", LONG),
    ("total_hours_scheduled_4weeks", NUM),
    ("total_hours_worked_4weeks", NUM),
    ("users_with_clock_in", T.DoubleType()),
    ("scheduled_clock_ins", T.DoubleType()),
    ("users_with_scheduled_shifts", T.DoubleType()),
    ("total_scheduled_shifts", T.DoubleType()),
    ("total_clock_ins", T.DoubleType()),
    ("total_hours_scheduled", T.DoubleType()),
    ("total_hours_worked", T.DoubleType()),
)


def require(df: DataFrame, contract: T.StructType | list[str], table: str) -> DataFrame:
    """Fail early, by name, when a table lacks contract columns."""
    names = contract.fieldNames() if isinstance(contract, T.StructType) else contract
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df
