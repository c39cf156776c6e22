"""The gate: unsound tables never become visible, and the writing job is the only scan."""

from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from laborloom.plans import gate
from laborloom.plans.publish import publish_checked_benchmarks
from laborloom.sources.sinks import rename_table


def _levels(spark, year=2001, locations=5, drop=None, short=None):
    rows = [
        (year, loc, code, 3 if (loc, code) == short else 4) for loc in range(locations) for code in range(7) if (loc, code) != drop
    ]
    return spark.createDataFrame(rows, "yr int, location_id long, day_of_week int, days_with_data long")


def _rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(str(path)).select("yr", "location_id", "day_of_week", "days_with_data").collect()))


@pytest.mark.parametrize("fault", [{"drop": (2, 3)}, {"short": (1, 6)}, {"locations": 0}])
def test_an_unsound_table_never_becomes_visible(spark, tmp_path, fault):
    path = tmp_path / "levels"
    with pytest.raises(gate.Rejected) as caught:
        gate.publish(_levels(spark, **fault), str(path), gate.benchmark_rules())
    assert any(not f.sound for f in caught.value.findings) and not list(tmp_path.iterdir())
    gate.publish(_levels(spark), str(path), gate.benchmark_rules())
    before = _rows(spark, path)
    with pytest.raises(gate.Rejected):
        gate.publish(_levels(spark, **fault), str(path), gate.benchmark_rules())
    assert _rows(spark, path) == before and [p.name for p in tmp_path.iterdir()] == ["levels"]


def test_a_sound_table_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path / "levels")
    gate.publish(_levels(spark), path, gate.benchmark_rules())
    findings = gate.publish(_levels(spark, locations=8), path, gate.benchmark_rules())
    assert len(_rows(spark, path)) == 56
    assert {f.rule: dict(f.metrics) for f in findings}["row_count"] == {"rows": 56}
    assert all(f.sound for f in findings)


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path, rules = str(tmp_path / "levels"), gate.benchmark_rules()
    for year in (1999, 2000):
        gate.publish(_levels(spark, year), path, rules, partition_by="yr")
    kept = {f for f in Path(path, "yr=1999").rglob("*.parquet")}
    gate.publish(_levels(spark, 2000, locations=6), path, rules, partition_by="yr")
    with pytest.raises(gate.Rejected):
        gate.publish(_levels(spark, 1999, drop=(0, 0)), path, rules, partition_by="yr")
    assert {f for f in Path(path, "yr=1999").rglob("*.parquet")} == kept
    assert len(_rows(spark, path)) == 35 + 42


def test_no_second_scan(spark, tmp_path):
    """As many jobs as a plain write has."""
    source = str(tmp_path / "source")
    _levels(spark).write.parquet(source)

    def jobs(run, group):
        spark.sparkContext.setJobGroup(group, group)
        run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    rows = spark.read.parquet(source)
    plain = jobs(lambda: rows.write.parquet(str(tmp_path / "plain")), "plain write")
    assert jobs(lambda: gate.publish(rows, str(tmp_path / "gated"), gate.benchmark_rules()), "gated write") == plain


def test_every_rule_judges(spark, tmp_path):
    first = date(2001, 1, 1)
    rows = [(first + timedelta(days=k), float(k) if k % 2 else None) for k in range(10) if k != 4]
    daily = spark.createDataFrame(rows, "event_date date, hours double")
    rules = [
        gate.row_count(1, 8),
        gate.no_missing_days("event_date", first, first + timedelta(days=9)),
        gate.null_share("hours", 0.6),
        gate.null_share("hours"),
        gate.within("hours", 0, 8),
        gate.within("hours", 0, 9),
    ]
    found = gate.write_observed(daily, str(tmp_path / "daily"), rules)
    assert [f.sound for f in found] == [False, False, True, False, False, True]
    assert found[1].metrics["on_2001-01-05"] == 0 and sum(found[1].metrics.values()) == 9
    with pytest.raises(ValueError):
        gate.publish(daily, str(tmp_path / "x"), [])


def test_an_interrupted_swap_is_undone(spark, tmp_path):
    path = str(tmp_path / "levels")
    gate.publish(_levels(spark), path, gate.benchmark_rules())
    rename_table(spark, path, f"{path}__old")  # ended between the renames
    with pytest.raises(gate.Rejected):
        gate.publish(_levels(spark, drop=(1, 1)), path, gate.benchmark_rules())
    assert len(_rows(spark, path)) == 35


def test_benchmarks_go_through_the_gate(spark, tmp_path):
    start = date(2001, 1, 7)
    rows = [(loc, start + timedelta(days=k), 10 * loc + k % 3, 100 * loc + k, 1, 0) for loc in range(3) for k in range(28)]
    events = spark.createDataFrame(rows, "location_id long, event_date date, user_id long, shift_id long, has_clock_in int, unscheduled int")
    events = events.withColumns({c: F.lit("x") for c in ("state", "msa", "industry", "city")})
    events = events.withColumns({c: F.lit(4).cast("decimal(8,4)") for c in ("hours_scheduled", "hours_worked")})
    windows, path = {2001: (start, start + timedelta(days=27))}, str(tmp_path / "levels")
    assert all(f.sound for f in publish_checked_benchmarks(events, windows, path))
    assert spark.read.parquet(path).count() == 21
    closed = events.filter((F.col("location_id") != 1) | (F.dayofweek("event_date") != 2) | (F.dayofmonth("event_date") > 10))
    with pytest.raises(gate.Rejected):
        publish_checked_benchmarks(closed, windows, path)
    assert spark.read.parquet(path).filter("days_with_data = 4").count() == 21
