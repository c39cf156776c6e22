"""The weekly table kept up to date: changed weeks go in, only what they reach is rebuilt.

The store keeps the stages of the weekly table as tables partitioned by week:

========================  ==================================================================
``user_weeks``            events reduced to location, week and worker
``marks``                 archiving dates found in each week's events
``location_weeks``        location totals with qualification flags
``first_seen``            each worker's first week (in each cut), by that week
``measures``              everything counted for a period, but for first-seen workers
``report``                the weekly table
========================  ==================================================================

A refresh reads the events of the changed weeks and closes over what depends on
them. A location-week's flags look back 12 and 52 rows, so the locations of those
weeks are qualified anew from their stored totals; the weeks since the earliest
change whose rows really differ are rewritten. A period is counted again when a flag or total changed in
it, up to four weeks ahead of it, up to ``lookback_weeks`` before it, or 364 days
before it; where only archiving marks changed, their count alone is taken anew. First-seen workers are state: those first seen before the earliest
change stay, the others are settled from the weeks since. The report is derived
from the measures, a few hundred rows per label, and compared with the stored
one, so exactly the weeks that differ are written.

An interrupted refresh is safe to repeat: the periods it was to count stay in
``pending`` until it has ended.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.functions.calendar import week_start
from laborloom.operators import weekly
from laborloom.operators.qualify import RULES, QualRule, location_weeks, qualified_weeks, user_weeks
from laborloom.operators.reuse import Staging, staging
from laborloom.periods import week_floor
from laborloom.sources.sinks import remove_table, replace_partitions, replace_table, table_exists

WEEK, YEAR = timedelta(days=7), timedelta(days=364)
MARK_COLUMNS = ("location_id", "user_id", "archived_at")


def _weeks(column: str, values: Iterable[date]) -> Column:
    """Membership in a list of weeks; literal, so it prunes partitions."""
    found = sorted(values)
    return F.col(column).isin(*found) if found else F.lit(False)


def _days_of(column: str, weeks: Sequence[date]) -> Column:
    """Days of the weeks, as few ranges on the raw column, which prune the scan of the events."""
    spans: list[list[date]] = []
    for week in sorted(weeks):
        if spans and spans[-1][1] == week - timedelta(days=1):
            spans[-1][1] = week + timedelta(days=6)
        else:
            spans.append([week, week + timedelta(days=6)])
    return reduce(lambda a, b: a | b, [F.col(column).between(F.lit(a), F.lit(b)) for a, b in spans], F.lit(False))


def _values(df: DataFrame, column: str) -> set[date]:
    """Distinct weeks of a table: bounded by the calendar, however long the table is."""
    return {r[0] for r in df.select(column).distinct().collect()}


def _differing(new: DataFrame, old: DataFrame, column: str) -> set[date]:
    """Weeks in which two tables differ as bags of rows; each table is read and moved once."""
    same = [name for name in new.columns]
    both = new.select(*same, F.lit(1).alias("copies")).unionByName(old.select(*same, F.lit(-1).alias("copies")))
    uneven = both.groupBy(*same).agg(F.sum("copies").alias("copies")).filter(F.col("copies") != 0)
    return _values(uneven, column)


@dataclass(frozen=True)
class WeeklyStore:
    """The stored weekly table under ``path``; the options are those of :func:`weekly.weekly_table`."""

    spark: SparkSession
    path: str
    as_of: date
    by: Sequence[str] = ()
    cuts: Mapping[str, str | None] | None = None
    first: str = "sunday"
    periods_back: int = 260
    lookback_weeks: int = 1
    rules: Sequence[QualRule] = RULES
    frame: str = "rows"
    literal_survival: bool = False
    files_per_partition: int = 8

    @property
    def keys(self) -> tuple[str, ...]:
        return weekly.CUT_KEYS if self.cuts else tuple(self.by)

    @property
    def labels(self) -> list[str]:
        return sorted({c for c in self.cuts.values() if c}) if self.cuts else list(self.by)

    @property
    def spine(self) -> weekly._Spine:
        return weekly._Spine(self.as_of, self.periods_back, self.first)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def report(self, min_locations: int | None = None) -> DataFrame:
        """The weekly table as stored."""
        table = self.table("report")
        return table if min_locations is None else table.filter(F.col("active_location_count") >= min_locations)

    # ------------------------------------------------------------ whole build

    def build(self, timeclock: DataFrame) -> None:
        """Build all tables from all events."""
        remove_table(self.spark, self.path)
        weeks = self._put(user_weeks(timeclock, self.labels, self.first), "user_weeks", "week_start")
        marks = self._archived(self._put(self._marks(timeclock), "marks", "event_week"))
        totals = location_weeks(weeks, self.labels, apart=bool(self.cuts))
        flagged = self._put(qualified_weeks(totals, self.rules, self.frame), "location_weeks", "week_start")
        seen = weekly.worker_rows(weeks, marks.limit(0))
        self._put(weekly.first_seen(weekly._with_flags(seen, flagged, self.labels), self.keys, self.cuts), "first_seen", "first_week")
        self._put(self._measures(None, weeks, flagged, marks), "measures", "period_start")
        self._put(self._derived(), "report", "period_start")
        self._note()

    def _put(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """Write a table whole and read it back: its files are listed once for all that is built from it."""
        path = f"{self.path}/{name}"
        replace_table(df, path, [column], self.files_per_partition)
        stored = self.spark.read.schema(df.schema).parquet(path)
        if not stored.inputFiles():
            # Keeps the columns of a table without rows.
            df.limit(0).write.mode("overwrite").parquet(path)
            return self.table(name)
        return stored

    # --------------------------------------------------------------- refresh

    def refresh(self, timeclock: DataFrame, weeks: Iterable[date]) -> dict[str, list[date]]:
        """Take up the events of ``weeks`` (any day of each) as they are now; returns the weeks rewritten in each table.

        ``timeclock`` is the whole, current event table; only the days of these weeks are read.
        """
        changed = sorted({week_floor(day, self.first) for day in weeks})
        with staging(self.spark, "weekly-refresh") as stage:
            return self._refresh(timeclock, changed, stage)

    def _refresh(self, timeclock: DataFrame, changed: list[date], stage: Staging) -> dict[str, list[date]]:
        spark = self.spark
        noted = self.table("state").first()
        if self.as_of < noted["as_of"]:
            raise ValueError(f"the store is at {noted['as_of']}, it cannot go back to {self.as_of}")
        pending = _values(self.table("pending"), "week") if table_exists(spark, f"{self.path}/pending") else set()
        events = timeclock.filter(_days_of("event_date", changed))
        fresh = stage.put(user_weeks(events, self.labels, self.first), "fresh-weeks")
        old_weeks = self.table("user_weeks").filter(_weeks("week_start", changed))
        touched = stage.put(fresh.select("location_id").unionByName(old_weeks.select("location_id")).distinct(), "touched")
        marks = stage.put(self._marks(events), "fresh-marks")
        archived = self._differing_marks(marks, changed)

        # Locations of the changed weeks, qualified anew over their whole history. Flags look back alone, so only weeks
        # from the earliest change on can differ.
        origin = min({*changed, *pending}, default=None)
        since = F.col("week_start") >= F.lit(origin) if origin else F.lit(False)
        stored = self.table("location_weeks")
        kept = stored.filter(~_weeks("week_start", changed)).join(touched, "location_id", "left_semi")
        totals = location_weeks(fresh, self.labels, apart=bool(self.cuts))
        whole = qualified_weeks(kept.select(*totals.columns).unionByName(totals), self.rules, self.frame)
        again = stage.put(whole.filter(since), "requalified")
        before = stored.filter(since).join(touched, "location_id", "left_semi").select(*again.columns)
        flags = _differing(again, before, "week_start")
        others = stored.filter(_weeks("week_start", flags)).join(touched, "location_id", "left_anti")
        located = others.select(*again.columns).unionByName(again.filter(_weeks("week_start", flags)))
        located = stage.put(located, "located")

        periods = self._closure({*flags, *changed}, noted["as_of"]) | pending
        told = {week for week in archived - periods if self.spine.first_week <= week <= self.spine.last_week}
        self._remember(periods | told | ({origin} if origin else set()))
        self._replace(fresh, "user_weeks", "week_start", changed)
        self._replace(marks, "marks", "event_week", changed)
        self._replace(located, "location_weeks", "week_start", flags)
        seen = self._refresh_first_seen(origin, stage) if origin else []
        weeks, flagged = self.table("user_weeks"), self.table("location_weeks")
        counted = self._archived(self.table("marks"))
        measures = self._measures(periods, weeks, flagged, counted).unionByName(self._told_measures(told, flagged, counted))
        periods = periods | told
        self._replace(stage.put(measures, "measures"), "measures", "period_start", periods)

        report = stage.put(self._derived(), "report")
        shown = _differing(report, self.table("report"), "period_start")
        self._replace(report.filter(_weeks("period_start", shown)), "report", "period_start", shown)
        self._note()
        remove_table(spark, f"{self.path}/pending")
        written = {"user_weeks": changed, "location_weeks": flags, "first_seen": seen, "measures": periods, "report": shown}
        return {name: sorted(found) for name, found in written.items()}

    def _replace(self, df: DataFrame, name: str, column: str, weeks: Iterable[date]) -> None:
        replace_partitions(df, f"{self.path}/{name}", column, weeks, self.files_per_partition)

    def _closure(self, flags: set[date], before: date) -> set[date]:
        """Periods that changes of location-weeks, and of ``as_of`` since ``before``, can reach."""
        reached = set()
        for week in flags:
            # Itself, as base of survival, as outlook of four weeks, and as week before or after a pair's.
            reached |= {week, week + YEAR, *[week - k * WEEK for k in range(1, 5)]}
            reached |= {week + k * WEEK for k in range(1, max(1, self.lookback_weeks) + 1)}
        now, then = self.spine, weekly._Spine(before, self.periods_back, self.first)
        if now.first_week != then.first_week or now.last_week != then.last_week:
            reached |= {now.first_week + k * WEEK for k in range(self.lookback_weeks + 1)}
            moved, week = (now.first_week - then.first_week) // WEEK, then.first_week
            reached |= {week + k * WEEK + YEAR for k in range(moved)}
            reached |= {then.last_week + k * WEEK for k in range(1, (now.last_week - then.last_week) // WEEK + 1)}
        if self.as_of != before:
            start = week_floor(before, self.first)
            reached |= {start + k * WEEK for k in range((self.as_of - start) // WEEK + 1)}
        return {week for week in reached if now.first_week <= week <= now.last_week}

    # ---------------------------------------------------------------- stages

    def _marks(self, events: DataFrame) -> DataFrame:
        """Archiving dates by the week of the events that tell them; which of them count depends on ``as_of``."""
        told = events.filter(F.col("archived_at").isNotNull() & F.col("event_date").isNotNull())
        return told.select(*MARK_COLUMNS, week_start("event_date", self.first).alias("event_week")).distinct()

    def _archived(self, marks: DataFrame) -> DataFrame:
        return weekly.archive_marks(marks, self.as_of, self.first)

    def _differing_marks(self, fresh: DataFrame, changed: Sequence[date]) -> set[date]:
        """Weeks of archiving dates that the changed weeks tell now and did not before, or the other way round."""
        old = self.table("marks").filter(_weeks("event_week", changed))
        week = week_start(F.col("archived_at").cast("date"), self.first).alias("week")
        new, old = (df.select(*MARK_COLUMNS, week) for df in (fresh, old))
        return _differing(new, old, "week")

    def _refresh_first_seen(self, origin: date, stage: Staging) -> list[date]:
        """Settle anew the workers that were not seen before ``origin``; their weeks since then are all that counts."""
        state = self.table("first_seen")
        whole = [weekly.CUT_KEYS[0]] if self.cuts else []
        known = state.filter(F.col("first_week") < F.lit(origin)).select(*whole, "user_id")
        weeks = self.table("user_weeks").filter(F.col("week_start") >= F.lit(origin))
        none = self._archived(self.table("marks")).limit(0)
        rows = weekly._with_flags(weekly.worker_rows(weeks, none), self.table("location_weeks"), self.labels)
        fresh = weekly.first_seen(rows, self.keys, self.cuts).join(known, [*whole, "user_id"], "left_anti")
        fresh = stage.put(fresh.select(*state.columns), "first-seen")
        gone = _values(state.filter(F.col("first_week") >= F.lit(origin)), "first_week")
        replaced = gone | _values(fresh, "first_week")
        self._replace(fresh, "first_seen", "first_week", replaced)
        return sorted(replaced)

    def _measures(self, periods: set[date] | None, weeks: DataFrame, flagged: DataFrame, marks: DataFrame) -> DataFrame:
        """Measures of the given periods, from the weeks these look at; of all periods of the spine for None."""
        week = F.col("week_start")
        if periods is None:
            # Weeks outside the spine count for no period in it, but as outlook of its last weeks.
            near = week.between(F.lit(self.spine.first_week), F.lit(self.spine.last_week + 4 * WEEK))
            back = self.spine.holds(week)
        else:
            near = _weeks("week_start", periods | {p - YEAR for p in periods} | {p + k * WEEK for p in periods for k in range(1, 5)})
            back = _weeks("week_start", {p - k * WEEK for p in periods for k in range(max(1, self.lookback_weeks) + 1)})
        rows = weekly.worker_rows(weeks.filter(back), marks.filter(back))
        flows = weekly.job_flows(
            weekly._by_worker(weekly._with_flags(rows, flagged.filter(back), self.labels)), self.spine, self.lookback_weeks
        )
        flagged = flagged.filter(near)
        located = weekly.location_measures(flagged, self.spine, self.keys, self.literal_survival, self.cuts)
        workers = weekly.worker_measures(flows, self.keys, self.cuts, debuts=False)
        merged = weekly.one_row_per_period(located.unionByName(workers, allowMissingColumns=True), self.keys)
        wanted = self.spine.holds(F.col("period_start")) if periods is None else _weeks("period_start", periods)
        return merged.filter(wanted)

    def _told_measures(self, periods: set[date], flagged: DataFrame, marks: DataFrame) -> DataFrame:
        """Stored measures of periods in which nothing but archiving marks has changed, with the one count these have anew."""
        here = _weeks("week_start", periods)
        rows = weekly._with_flags(marks.filter(here), flagged.filter(here), self.labels).filter(weekly._is("turnover"))
        workers = weekly._in_each_cut(rows, self.cuts).select(*self.keys, F.col("week_start").alias("period_start"), "user_id").distinct()
        counts = workers.groupBy(*self.keys, "period_start").agg(F.count(F.lit(1)).alias("workers_archived"))
        stored = self.table("measures").filter(_weeks("period_start", periods)).drop("workers_archived")
        return weekly.one_row_per_period(stored.unionByName(counts, allowMissingColumns=True), self.keys)

    def _derived(self) -> DataFrame:
        """The report from the stored measures and first weeks."""
        debuts = self.table("first_seen").groupBy(*self.keys, F.col("first_week").alias("period_start"))
        parts = self.table("measures").unionByName(debuts.agg(F.count(F.lit(1)).alias("workers_new")), allowMissingColumns=True)
        if self.cuts:
            every = weekly.national_weeks(self.spark, self.as_of, self.periods_back, self.first, self.cuts)
            parts = parts.unionByName(every, allowMissingColumns=True)
        measures = weekly.one_row_per_period(parts, self.keys)
        return weekly.report_table(measures, self.as_of, self.keys, self.first, self.periods_back)

    # ----------------------------------------------------------------- notes

    def _note(self) -> None:
        self.spark.range(1).select(F.lit(self.as_of).alias("as_of")).write.mode("overwrite").parquet(f"{self.path}/state")

    def _remember(self, weeks: set[date]) -> None:
        listed = F.array(*[F.lit(week) for week in sorted(weeks)]).cast("array<date>")
        self.spark.range(1).select(F.explode(listed).alias("week")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pending")
