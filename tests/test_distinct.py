"""Mergeable distinct counts against plain sets."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from laborloom.operators import distinct

SCHEMA = "event_date date, industry string, state string, user_id long"


def _rows(workers=900, first=0, start=date(2001, 1, 1), days=75, seed=1):
    rng = random.Random(seed)
    rows = []
    for day in range(days):
        for user in rng.sample(range(workers), 60):
            state = rng.choice(["A", "B", None]) if user % 10 == 0 else "AB"[user % 2]
            rows += [(start + timedelta(days=day), f"i{user % 3}", state, first + user)] * rng.randint(1, 2)
    rows += [(start + timedelta(days=d), "i0", "A", 5) for d in range(days)]  # a worker of every day
    return [*rows, (start, "i0", "A", None), (start, None, None, 17)]


def _expected(rows, period, by):
    sets = {}
    for day, industry, state, user in rows:
        if user is not None:
            labels = {"industry": industry, "state": state}
            sets.setdefault((period(day), *[labels[name] for name in by]), set()).add(user)
    return {key: len(users) for key, users in sets.items()}


def _found(table, by):
    return {(r["period_start"], *[r[name] for name in by]): r["workers"] for r in table.collect()}


WEEK = lambda day: day - timedelta(days=day.isoweekday() % 7)
MONTH = lambda day: day.replace(day=1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = _rows()
    events = spark.createDataFrame(rows, SCHEMA)
    codes = distinct.worker_codes(events)
    path = str(tmp_path_factory.mktemp("bitmaps") / "t")
    return rows, codes, path, distinct.store_bitmaps(distinct.daily_bitmaps(events, codes), path, 1)


def test_codes_are_dense_and_keep_homes_together(stored, spark):
    rows, codes, _, _ = stored
    found = {r["user_id"]: r["code"] for r in codes.collect()}
    assert sorted(found.values()) == list(range(len({r[3] for r in rows} - {None})))
    homes = {}
    for _, industry, state, user in rows:
        if user is not None and user % 10:
            homes.setdefault((industry, state), set()).add(found[user])
    # Codes of a home lie in one run, but for the few workers with several homes.
    spans = [max(c) - min(c) - len(c) for c in homes.values() if len(c) > 20]
    assert max(spans) < len(found) / 2


@pytest.mark.parametrize("by", [(), ("state",), ("industry",), ("industry", "state")])
def test_rollups_equal_plain_sets(stored, by):
    rows, _, _, table = stored
    kinds = distinct.periods()
    for name, period in (("day", lambda day: day), ("week", WEEK), ("month", MONTH)):
        assert _found(distinct.distinct_workers(table, kinds[name], by), by) == _expected(rows, period, by)
        cube = distinct.distinct_workers_cube(table).filter(
            (F.col("period") == name) & (F.col("by_industry") == ("industry" in by)) & (F.col("by_state") == ("state" in by))
        )
        assert _found(cube, by) == _expected(rows, period, by)


def test_new_workers_and_rebuilt_months(stored, spark):
    rows, codes, path, _ = stored
    # February is rebuilt with other events, and workers never seen before.
    february = [r for r in _rows(workers=300, first=700, seed=2) if r[0].month == 2]
    events = spark.createDataFrame(february, SCHEMA)
    kept = {r["user_id"]: r["code"] for r in codes.collect()}
    more = distinct.extended_codes(codes, events)
    assert {u: c for u, c in ((r["user_id"], r["code"]) for r in more.collect()) if u in kept} == kept
    assert more.select("code").distinct().count() == more.count() == more.agg(F.max("code")).first()[0] + 1
    table = distinct.store_bitmaps(distinct.daily_bitmaps(events, more), path, 1)
    now = [r for r in rows if r[0].month != 2] + february
    for by in ((), ("state",)):
        assert _found(distinct.distinct_workers(table, distinct.periods()["month"], by), by) == _expected(now, MONTH, by)
        assert _found(distinct.distinct_workers(table, distinct.periods()["week"], by), by) == _expected(now, WEEK, by)


def test_rollups_scan_the_table_once_and_keep_long_buffers(stored):
    cube = distinct.distinct_workers_cube(stored[3])
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_no_events(spark):
    events = spark.createDataFrame([], SCHEMA)
    codes = distinct.worker_codes(events)
    assert codes.count() == 0 and distinct.daily_bitmaps(events, codes).count() == 0
    assert distinct.extended_codes(codes, spark.createDataFrame([(date(2001, 1, 1), "i", "A", 9)], SCHEMA)).collect()[0][:] == (9, 0)
