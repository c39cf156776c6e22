"""Weekly table on a fixture with missing ids, gaps and archived places."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import duckdb
import pytest

from catalog.compare import _bag
from catalog.weekly_queries import _table_ctes
from catalog.common import AS_OF
from laborloom.operators import qualify, weekly

SCHEMA = (
    "location_id long, event_date date, user_id long, shift_id long, hours_worked decimal(18,4), "
    "hourly_wage_rate decimal(18,4), total_wages_earned decimal(18,4), archived_at date, loc_archived_at date, state string"
)


def _rows():
    rng = random.Random(7)
    rows, shift = [], 0
    for week in range(90):
        monday = date(2000, 3, 6) + timedelta(weeks=week)
        for location in range(4):
            if location == 2 and 30 <= week < 41:
                continue  # ten silent weeks
            if location == 3 and week > 60:
                continue
            for user in rng.sample(range(30), rng.randint(4, 16)):
                for _ in range(rng.randint(1, 2)):
                    shift += 1
                    hours = Decimal(rng.randint(0, 80)) / 10 if rng.random() < 0.8 else None
                    rate = Decimal(rng.randint(6, 20)) if rng.random() < 0.7 else None
                    rows.append(
                        (
                            location if rng.random() < 0.99 else None,
                            monday + timedelta(days=rng.randint(-1, 5)),
                            user if rng.random() < 0.95 else None,
                            shift if rng.random() < 0.9 else None,
                            hours,
                            rate,
                            hours * rate if hours is not None and rate is not None else None,
                            date(2001, 1, 1) + timedelta(days=user * 9) if user % 3 == 0 else None,
                            date(2001, 5, 2) if location == 3 else None,
                            "A" if location < 2 else "B",
                        )
                    )
    return rows


@pytest.fixture(scope="module")
def clock(spark):
    rows = _rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE timeclock (location_id BIGINT, event_date DATE, user_id BIGINT, shift_id BIGINT, "
        "hours_worked DECIMAL(18,4), hourly_wage_rate DECIMAL(18,4), total_wages_earned DECIMAL(18,4), "
        "archived_at DATE, loc_archived_at DATE, state VARCHAR)"
    )
    con.executemany("INSERT INTO timeclock VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return frame, con


def _expected(con, **options):
    ctes = _table_ctes(**options)
    ctes["wk"] += " WHERE location_id IS NOT NULL"
    text = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + " SELECT * FROM report"
    result = con.execute(text)
    return _bag(result.fetchall(), [column[0] for column in result.description])


@pytest.mark.parametrize(
    "ours, theirs",
    [
        ({}, {}),
        ({"by": ["state"]}, {"by": "state"}),
        ({"lookback_weeks": 4}, {"lookback": 4}),
        ({"literal_survival": True}, {"literal": True}),
        ({"first": "monday"}, {"first": "monday"}),
    ],
)
def test_weekly_table(clock, ours, theirs):
    frame, con = clock
    df = weekly.weekly_table(frame, AS_OF, **ours)
    found, expected = _bag(df.collect(), df.columns), _expected(con, **theirs)
    assert found == expected


def test_staged_and_lazy_plans_agree(clock, monkeypatch):
    frame, _ = clock
    staged = weekly.weekly_table(frame, AS_OF)
    assert "user-weeks" in "".join(staged.inputFiles())
    monkeypatch.setattr(weekly, "computed_once", lambda df, name: df)
    lazy = weekly.weekly_table(frame, AS_OF)
    assert sorted(map(str, lazy.collect())) == sorted(map(str, staged.collect()))


def test_pair_flows_balance(clock):
    """On pairs, joiners minus leavers is the change of pairs at work."""
    frame, _ = clock
    weeks = qualify.user_weeks(frame)
    flagged = qualify.qualified_weeks(qualify.location_weeks(weeks))
    from pyspark.sql import functions as F

    rows = weeks.filter("user_id is not null").withColumn("archive_mark", F.lit(False))
    spine = weekly._Spine(AS_OF, 260, "sunday")
    flows = weekly.job_flows(weekly._with_flags(rows, flagged, []), spine)
    per_week = {
        r.week_start: r
        for r in flows.groupBy("week_start")
        .agg(F.count("pair").alias("n"), F.sum(F.col("joined").cast("int")).alias("j"), F.sum(F.col("leaves_next").cast("int")).alias("l"))
        .collect()
    }
    checked = 0
    for week, now in per_week.items():
        before = per_week.get(week - timedelta(days=7))
        if before is not None:
            assert now.j - before.l == now.n - before.n
            checked += 1
    assert checked > 40


def test_row_frames_are_not_calendar_frames(clock):
    frame, _ = clock
    rows = qualify.location_flags(frame).filter("location_id = 2").select("week_start", "weeks_active_52w").collect()
    calendar = (
        qualify.location_flags(frame, frame="calendar").filter("location_id = 2").select("week_start", "weeks_active_52w").collect()
    )
    last_rows, last_calendar = max(rows), max(calendar)
    assert last_rows[0] == last_calendar[0] and last_rows[1] > last_calendar[1]
    with pytest.raises(ValueError):
        qualify.location_flags(frame, frame="days")


def test_hot_location_is_split_by_worker(spark):
    """A location with most rows shuffles by (location, week, worker)."""
    frame = spark.createDataFrame([], SCHEMA)
    plan = qualify.user_weeks(frame)._jdf.queryExecution().toString()
    key = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line][0]
    assert "user_id" in key and "location_id" in key


def _steady(spark, moves, weeks=30, workers=8):
    """One location whose label changes at half time, or workers who change location then."""
    rows = []
    for week in range(weeks):
        day, late = date(2000, 1, 3) + timedelta(weeks=week), week >= weeks // 2
        for user in range(workers):
            if moves == "label":
                rows.append((1, day, user, len(rows), "B" if late else "A"))
            else:
                rows += [(1, day, user, 2 * len(rows), "A"), (2, day, user + 100 if not (late and user == 0) else 0, 2 * len(rows) + 1, "B")]
    rows = [(loc, day, user, shift, Decimal(8), Decimal(10), Decimal(80), None, None, state) for loc, day, user, shift, state in rows]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_relabelled_location_stays_one_location(spark):
    frame = _steady(spark, "label")
    as_of = date(2000, 8, 20)
    national = weekly.weekly_table(frame, as_of).agg({"active_location_count": "sum", "jobs_added": "sum"}).first()
    by_state = weekly.weekly_table(frame, as_of, by=["state"]).agg({"active_location_count": "sum", "jobs_added": "sum"}).first()
    assert national == by_state
    assert national["sum(active_location_count)"] == 19


def test_workers_are_first_seen_once(spark):
    frame = _steady(spark, "worker", workers=12)
    as_of = date(2000, 8, 20)
    national = weekly.weekly_table(frame, as_of).agg({"users_added": "sum"}).first()[0]
    by_state = weekly.weekly_table(frame, as_of, by=["state"]).agg({"users_added": "sum"}).first()[0]
    assert national == by_state == 24


def test_history_follows_periods_back(spark):
    assert weekly.weekly_table(_steady(spark, "label"), date(2000, 8, 20), periods_back=520).count() >= 519


CUTS = {"national": None, "state": "state", "area": "msa"}


def _with_areas(frame):
    """Areas change with the day, so a location's label changes within weeks; some are null."""
    from pyspark.sql import functions as F

    day = F.dayofyear("event_date")
    area = F.when(day % 50 == 0, None).otherwise(F.concat(F.lit("area "), (F.col("location_id") % 2 + F.floor(day / 45)).cast("string")))
    return frame.withColumn("msa", area)


def test_all_cuts_equal_the_separate_tables(clock):
    from pyspark.sql import functions as F

    frame = _with_areas(clock[0])
    cuts = weekly.weekly_table(frame, AS_OF, cuts=CUTS)
    expected = weekly.weekly_table(frame, AS_OF).select(F.lit("national").alias("segmented_by"), F.lit("national").alias("segment"), "*")
    for name, column in (("state", "state"), ("area", "msa")):
        one = weekly.weekly_table(frame, AS_OF, by=[column]).withColumnRenamed(column, "segment")
        expected = expected.unionByName(one.withColumn("segmented_by", F.lit(name)))
    assert _bag(cuts.collect(), cuts.columns) == _bag(expected.collect(), expected.columns)
    few = weekly.weekly_table(frame, AS_OF, cuts=CUTS, min_locations=2)
    assert 0 < few.count() < cuts.count()
    with pytest.raises(ValueError):
        weekly.weekly_table(frame, AS_OF, by=["state"], cuts=CUTS)


def test_all_cuts_scan_the_events_twice(clock, monkeypatch, tmp_path):
    _with_areas(clock[0]).write.parquet(str(tmp_path / "events"))
    frame = clock[0].sparkSession.read.parquet(str(tmp_path / "events"))
    scans, stage = [], weekly.computed_once

    def watched(df, name):
        scans.append(df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet"))
        return stage(df, name)

    monkeypatch.setattr(weekly, "computed_once", watched)
    table = weekly.weekly_table(frame, AS_OF, cuts=CUTS)
    lines = [x for x in table._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan parquet" in x]
    # One scan for the worker-weeks, one (of three columns) for the archiving marks; the rest reads staged tables.
    assert scans[0] == 1
    assert len([x for x in lines if "archived_at" in x]) == 1
    assert not any("shift_id" in x for x in lines)


def test_labels_do_not_make_the_event_aggregate_sort(clock):
    weeks = qualify.user_weeks(_with_areas(clock[0]), ["state", "msa"])
    plan = weeks._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
