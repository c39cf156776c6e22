"""Refreshing the stored weekly table gives what a full rebuild gives, and rewrites only what changed."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog.compare import _bag
from laborloom.operators import weekly
from laborloom.plans.weekly_store import WeeklyStore
from tests.test_weekly import SCHEMA, _rows

AS_OF = date(2001, 9, 30)
CUTS = {"national": None, "state": "state"}
CHANGED = date(2001, 5, 9)


def _week(day):
    return day - timedelta(days=day.isoweekday() % 7)


def _rows_of(df):
    return _bag(df.select(*sorted(df.columns)).collect(), sorted(df.columns))


def _files(path, name):
    return {str(f): f.stat().st_mtime_ns for f in Path(path, name).rglob("*.parquet")}


def _partitions(before, after):
    """Weeks whose files differ."""
    moved = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    return {date.fromisoformat(Path(f).parent.name.split("=")[1]) for f in moved}


def _edited(rows, changed):
    """Other hours, fewer and new workers in one week; an archiving date told there alone."""
    out = []
    for k, r in enumerate(rows):
        if _week(r[1]) == _week(changed):
            if k % 3 == 0:
                continue
            r = (*r[:2], r[2] if k % 3 == 1 else 700 + k % 5, r[3], Decimal("3.5"), *r[5:])
            if k % 7 == 1:
                r = (*r[:7], date(2001, 6, 20), *r[8:])
        out.append(r)
    return out


@pytest.fixture(scope="module")
def long():
    """More than a year, so that survival has a base."""
    return [r for r in _rows() if r[1] <= AS_OF]


@pytest.fixture(scope="module")
def rows(long):
    # Half a year, for tests of which weeks are touched: a store has files for every week.
    return [r for r in long if r[1] >= date(2001, 1, 14)]


@pytest.mark.parametrize(
    "options",
    [{}, {"cuts": CUTS}, {"by": ("state",), "lookback_weeks": 4, "frame": "calendar", "first": "monday", "literal_survival": True}],
)
def test_refresh_equals_full_rebuild(spark, tmp_path, rows, long, options):
    rows = long if "cuts" in options else rows
    path, edited = str(tmp_path / "store"), _edited(rows, CHANGED)
    store = WeeklyStore(spark, path, AS_OF, files_per_partition=1, **options)
    store.build(spark.createDataFrame(rows, SCHEMA))
    assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(spark.createDataFrame(rows, SCHEMA), AS_OF, **options))
    names = ("user_weeks", "location_weeks", "measures", "report")
    before = {name: _files(path, name) for name in names}
    events = spark.createDataFrame(edited, SCHEMA)
    # The edited days lie in one week from Sunday, in two from Monday.
    days = [_week(CHANGED) + timedelta(days=k) for k in range(7)]
    written = store.refresh(events, days)
    assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(events, AS_OF, **options))
    after = {name: _files(path, name) for name in names}
    for name in names:
        assert _partitions(before[name], after[name]) <= set(written[name])
        assert len(written[name]) < len(after[name])
    monday = timedelta(days=1)
    one = [_week(CHANGED)]
    assert written["user_weeks"] == ([one[0] - 6 * monday, one[0] + monday] if options.get("first") == "monday" else one)
    # Nothing changes when the same weeks come again.
    again = store.refresh(events, days)
    assert again["location_weeks"] == again["report"] == []
    assert not Path(path, "pending").exists()


def test_a_late_week_touches_few_partitions(spark, tmp_path, rows):
    """The usual case: the last week comes in, ``as_of`` moves on."""
    path, last = str(tmp_path / "store"), max(r[1] for r in rows)
    cut = _week(last)
    early = spark.createDataFrame([r for r in rows if r[1] < cut], SCHEMA)
    whole = spark.createDataFrame(rows, SCHEMA)
    WeeklyStore(spark, path, cut - timedelta(days=1), files_per_partition=1, cuts=CUTS, periods_back=60).build(early)
    before = _files(path, "measures")
    store = WeeklyStore(spark, path, cut + timedelta(days=6), files_per_partition=1, cuts=CUTS, periods_back=60)
    written = store.refresh(whole, [last])
    assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(whole, store.as_of, cuts=CUTS, periods_back=60))
    assert written["location_weeks"] == [cut] and len(written["measures"]) <= 12
    assert _partitions(before, _files(path, "measures")) <= set(written["measures"])
    with pytest.raises(ValueError):
        WeeklyStore(spark, path, cut - timedelta(days=1), cuts=CUTS, periods_back=60).refresh(whole, [last])


def test_weeks_without_events_leave_the_store(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    store = WeeklyStore(spark, path, AS_OF, files_per_partition=1)
    store.build(spark.createDataFrame(rows, SCHEMA))
    left = spark.createDataFrame([r for r in rows if _week(r[1]) != _week(CHANGED)], SCHEMA)
    store.refresh(left, [CHANGED])
    assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(left, AS_OF))
    assert store.table("user_weeks").filter(F.col("week_start") == F.lit(_week(CHANGED))).count() == 0


def test_an_interrupted_refresh_can_be_repeated(spark, tmp_path, rows, monkeypatch):
    path, edited = str(tmp_path / "store"), spark.createDataFrame(_edited(rows, CHANGED), SCHEMA)
    store = WeeklyStore(spark, path, AS_OF, files_per_partition=1)
    store.build(spark.createDataFrame(rows, SCHEMA))

    def lost(self, origin, stage):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(WeeklyStore, "_refresh_first_seen", lost)
        with pytest.raises(RuntimeError):
            store.refresh(edited, [CHANGED])
    store.refresh(edited, [CHANGED])
    assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(edited, AS_OF))


def test_only_the_changed_days_are_read(spark, tmp_path, rows):
    from laborloom.plans.weekly_store import _days_of

    spark.createDataFrame(rows, SCHEMA).write.partitionBy("event_date").parquet(str(tmp_path / "events"))
    read = spark.read.parquet(str(tmp_path / "events")).filter(_days_of("event_date", [_week(CHANGED), _week(CHANGED) + timedelta(days=7)]))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.count(">=") <= 2
    assert {r[0] for r in read.select("event_date").distinct().collect()} <= {_week(CHANGED) + timedelta(days=k) for k in range(14)}


def test_workers_move_once_and_only_later_weeks_are_compared(spark, tmp_path, rows, monkeypatch):
    """The rows of workers have one exchange by worker, within the weeks of the report; a refresh compares no week before its first."""
    import re

    from laborloom.plans import weekly_store

    path, compared, plans = str(tmp_path / "store"), [], []
    differing, measures = weekly_store._differing, WeeklyStore._measures
    monkeypatch.setattr(weekly_store, "_differing", lambda new, old, column: (compared.append((new, column, new.toPandas()[column].min())), differing(new, old, column))[1])

    def planned(self, *given):
        found = measures(self, *given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(WeeklyStore, "_measures", planned)
    store = WeeklyStore(spark, path, AS_OF, files_per_partition=1, periods_back=20)
    store.build(spark.createDataFrame(rows, SCHEMA))
    edited = spark.createDataFrame(_edited(rows, date(2001, 8, 8)), SCHEMA)
    store.refresh(edited, [date(2001, 8, 8)])
    # The distinct archiving marks, and the rows of workers.
    assert [len(re.findall(r"Exchange hashpartitioning\([^)]*user_id", plan)) for plan in plans] == [2, 2]
    assert str(store.spine.first_week) in plans[0]
    assert [least for _, column, least in compared if column == "week_start"] == [_week(date(2001, 8, 8))]
    assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(edited, AS_OF, periods_back=20))


def test_marks_told_late_are_counted_without_the_weeks_of_workers(spark, tmp_path, rows, monkeypatch):
    """An archiving date of June told in a week of September: only the count of archived workers is new in June."""
    late, told = date(2001, 9, 12), date(2001, 6, 20)
    asked = []
    measures = WeeklyStore._measures
    monkeypatch.setattr(WeeklyStore, "_measures", lambda self, periods, *given: (asked.append(periods), measures(self, periods, *given))[1])
    edited = [(*r[:7], told, *r[8:]) if _week(r[1]) == _week(late) and k % 5 == 1 else r for k, r in enumerate(rows)]
    for k, options in enumerate([{}, {"cuts": CUTS}]):
        store = WeeklyStore(spark, str(tmp_path / f"store{k}"), AS_OF, files_per_partition=1, **options)
        store.build(spark.createDataFrame(rows, SCHEMA))
        before = {(r["period_start"], *[r[key] for key in store.keys]): r["users_archived"] for r in store.report().collect()}
        written = store.refresh(spark.createDataFrame(edited, SCHEMA), [late])
        assert _week(told) not in asked[-1] and _week(told) in written["measures"]
        assert _rows_of(store.report()) == _rows_of(weekly.weekly_table(spark.createDataFrame(edited, SCHEMA), AS_OF, **options))
        after = {(r["period_start"], *[r[key] for key in store.keys]): r["users_archived"] for r in store.report().collect()}
        assert any(after[key] > before[key] for key in after if key[0] == _week(told))
