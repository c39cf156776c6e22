"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import all_queries  # noqa: E402
from laborloom.session import local_session  # noqa: E402

HEADLINE = (
    "labor_index_monthly",
    "labor_index_month_benchmark",
    "labor_index_by_industry",
    "weekday_benchmark",
    "weekly_table",
    "weekly_table_by_state",
    "wages_all_cuts",
    "wages_national",
    "wages_by_industry",
    "hiring_per_location",
    "turnover_per_location",
    "shifts_worked",
    "event_significance",
    "employees_by_industry",
    "shift_events_build",
    "timeclock_build",
    "overview",
)
# Timed too, but not part of the total, which stays comparable over time.
FURTHER = ("weekly_table_all_cuts",)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One untimed pass starts the executors and loads the code paths.
    queries["labor_index_monthly"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in (*HEADLINE, *FURTHER):
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds[name] for name in HEADLINE), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
