"""Fixed labels and the row predicates built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State labels that are not part of the US market.
OUTSIDE_US = ("Not USA", "Unclassified")

# Labels used when a lookup has no entry.
STATE_FALLBACK = "Unclassified"
MSA_FALLBACK = "All other"
INDUSTRY_FALLBACK = "Unknown"

# Employee size bands (lower bound, label); the dash is U+2013.
SIZE_BANDS = (
    (0, "0 employees"),
    (1, "1–4 employees"),
    (5, "5–9 employees"),
    (10, "10–19 employees"),
    (20, "20–49 employees"),
    (50, "50–99 employees"),
    (100, "100–249 employees"),
    (250, "250–499 employees"),
    (500, "500–999 employees"),
)
SIZE_UNKNOWN = "Unknown"
SIZE_LIMIT = 1000

# Bands and minimum age of the ad hoc qualification rule.
QUALIFIED_BANDS = ("5–9 employees", "10–19 employees", "20–49 employees", "50–99 employees")
TURNOVER_BANDS = ("10–19 employees", "20–49 employees", "50–99 employees")
QUALIFIED_AGE_DAYS = 84

# Audit-log actors that archive jobs without a departure.
SYSTEM_ACTORS = (
    "%rake businesses:archive_invoiced_company%",
    "%lockjobworker%",
    "%handlejobterminationworker%",
)


def in_us(state: Column | str) -> Column:
    """Rows of the US market; a missing state is dropped as well."""
    state = F.col(state) if isinstance(state, str) else state
    return ~state.isin(*OUTSIDE_US)


def size_band(count: Column | str) -> Column:
    count = F.col(count) if isinstance(count, str) else count
    band = F.when(count.isNull() | (count < 0) | (count >= SIZE_LIMIT), SIZE_UNKNOWN)
    for floor, label in reversed(SIZE_BANDS):
        band = band.when(count >= floor, label)
    return band


def inline_qualified(turnover: bool = False) -> Column:
    """Size, age and still-open rule for tables without weekly flags."""
    bands = TURNOVER_BANDS if turnover else QUALIFIED_BANDS
    return (
        F.col("employee_count").isin(*bands)
        & (F.col("location_age") >= QUALIFIED_AGE_DAYS)
        & F.col("loc_archived_at").isNull()
    )


def system_actor(actor: Column | str) -> Column:
    """True when a system process made the change; NULL for an unknown actor."""
    lowered = F.lower(F.col(actor) if isinstance(actor, str) else actor)
    hit = lowered.like(SYSTEM_ACTORS[0])
    for pattern in SYSTEM_ACTORS[1:]:
        hit = hit | lowered.like(pattern)
    return hit


def age_years(days: Column | str) -> Column:
    return (F.col(days) if isinstance(days, str) else days) / F.lit(365.25)
