"""Distinct workers from stored daily bitmaps."""

from __future__ import annotations

from catalog.adapter_sql import sunday, using
from laborloom.operators import distinct
from laborloom.operators.reuse import shared_path
from laborloom.sources import star_adapter as sample
from pyspark.sql import functions as F


def _stored(spark, sf):
    """Workers with a clock-in by day, industry and state, after a round through the stored table."""
    path = shared_path(spark, "worker-bitmaps")
    if path is None:
        raise ValueError("set spark.checkpoint.dir: the query goes through a written table")
    events = sample.shift_events(spark, sf).filter(F.col("has_clock_in") == 1)
    return distinct.store_bitmaps(distinct.daily_bitmaps(events, distinct.worker_codes(events)), path, files_per_partition=1)


QUERIES = {
    "distinct_workers_cube": lambda s, d: distinct.distinct_workers_cube(_stored(s, d)),
    "distinct_workers_weekly": lambda s, d: distinct.distinct_workers(_stored(s, d), distinct.periods("monday")["week"]),
    "worker_codes": lambda s, d: distinct.worker_codes(sample.shift_events(s, d)).agg(
        F.count(F.lit(1)).alias("workers"), F.count_distinct("code").alias("codes"), F.min("code").alias("first"), F.max("code").alias("last")
    ),
}

# ---------------------------------------------------------------- SQL twins

_PERIODS = {"day": "event_date", "week": sunday("event_date"), "month": "CAST(date_trunc('month', event_date) AS DATE)"}


def _cube() -> str:
    parts = []
    for name, start in _PERIODS.items():
        for industry in (False, True):
            for state in (False, True):
                parts.append(
                    f"""SELECT '{name}' AS period, {start} AS period_start,
                        {'industry' if industry else 'CAST(NULL AS VARCHAR)'} AS industry,
                        {'state' if state else 'CAST(NULL AS VARCHAR)'} AS state,
                        {str(industry).lower()} AS by_industry, {str(state).lower()} AS by_state,
                        count(DISTINCT user_id) AS workers FROM clocked GROUP BY ALL"""
                )
    return " UNION ALL ".join(parts)


_CLOCKED = "SELECT * FROM shift_events WHERE has_clock_in = 1"

SQL = {
    "distinct_workers_cube": using("shift_events", _cube(), clocked=_CLOCKED),
    "distinct_workers_weekly": using(
        "shift_events",
        """SELECT CAST(date_trunc('week', event_date) AS DATE) AS period_start, count(DISTINCT user_id) AS workers
           FROM clocked GROUP BY ALL""",
        clocked=_CLOCKED,
    ),
    "worker_codes": using(
        "shift_events",
        """SELECT count(DISTINCT user_id) AS workers, count(DISTINCT user_id) AS codes, CAST(0 AS BIGINT) AS first,
                  count(DISTINCT user_id) - 1 AS last FROM shift_events""",
    ),
}
