"""The weekly table from a stored layout in which most of its shuffles are already done.

========================  ==========================  =========================================
table                     bucketed by                 holds
========================  ==========================  =========================================
``locations``             location                    location-week totals with their flags
``flags``                 location, part              the flags and labels worker metrics use, by week
``workers``               location, part              worker-weeks and archiving dates
========================  ==========================  =========================================

``part`` is the hash of the worker, so the largest location's workers lie in many
buckets; the narrow flags are stored once for each part, a location's weeks in one
row, so that the join's keys are those of the buckets. Worker rows meet their flags
bucket by bucket, and windows over (worker, location) run inside buckets too, since
a worker's part is a function of the worker. Windows over a location run
inside the buckets of ``locations``. What is left to shuffle are the rows reduced
to periods. The layout pays where several reports (dates, cuts, look-backs) are
made from the same weeks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.operators import weekly
from laborloom.operators.qualify import RULES, QualRule, location_weeks, qualified_weeks, user_weeks
from laborloom.operators.reuse import Staging, staging
from laborloom.sources.layout import Bucketed, in_every_part, part_of

MARKS = ("location_id", "user_id", "archived_at")
FLAGS = ("qualified_for_jobs", "qualified_for_turnover", "qualified_for_wages")


@dataclass(frozen=True)
class WeeklyLayout:
    """The layout under ``folder``; ``labels`` are the location attributes that reports may be cut by."""

    spark: SparkSession
    folder: str
    prefix: str
    labels: Sequence[str] = ()
    first: str = "sunday"
    buckets: int = 200
    parts: int = 16

    def _table(self, name: str) -> Bucketed:
        by = ("location_id",) if name == "locations" else ("location_id", "part")
        return Bucketed(f"{self.prefix}_{name}", f"{self.folder}/{name}", by, self.buckets, by if name == "flags" else (*by, "week_start"))

    def store(self, timeclock: DataFrame, rules: Sequence[QualRule] = RULES, frame: str = "rows") -> None:
        """Build the tables from the events: each stage is read from the table stored before it."""
        with staging(self.spark, "weekly-layout") as stage:
            self._store(timeclock, rules, frame, stage)

    def _store(self, timeclock: DataFrame, rules: Sequence[QualRule], frame: str, stage: Staging) -> None:
        events = stage.put(user_weeks(timeclock, self.labels, self.first), "user-weeks")
        totals = stage.put(location_weeks(events, self.labels, apart=True), "location-totals")
        located = self._table("locations").write(qualified_weeks(totals, rules, frame))
        wanted = located.filter(" or ".join(f"{flag} = 1" for flag in FLAGS))
        # One entry for each week of a location.
        week = F.struct("week_start", F.struct(*self.labels, *FLAGS).alias("flags"))
        weeks_of = wanted.groupBy("location_id").agg(F.map_from_entries(F.sort_array(F.collect_list(week))).alias("weeks"))
        self._table("flags").write(in_every_part(weeks_of, self.parts))
        told = timeclock.filter(F.col("archived_at").isNotNull() & F.col("location_id").isNotNull() & F.col("user_id").isNotNull())
        marks = told.select(*MARKS).distinct().withColumn("week_start", weekly.week_start(F.col("archived_at").cast("date"), self.first))
        rows = events.filter(F.col("user_id").isNotNull()).select(
            "location_id", "week_start", "user_id", "shift_rows", "shift_hours", "pay_rows"
        )
        rows = rows.unionByName(marks, allowMissingColumns=True)
        self._table("workers").write(rows.withColumn("part", part_of("user_id", self.parts)))

    def location_flags(self) -> DataFrame:
        return self._table("locations").read(self.spark)

    def flagged_workers(self, as_of: date) -> DataFrame:
        """Worker-weeks, and archiving marks before ``as_of``, with flags and labels: joined without an exchange."""
        workers = self._table("workers").read(self.spark)
        mark = F.col("archived_at").isNotNull()
        rows = workers.filter(~mark | (F.col("archived_at") < F.lit(as_of))).withColumn("archive_mark", mark)
        met = rows.join(self._table("flags").read(self.spark), ["location_id", "part"])
        found = met.withColumn("flags", F.try_element_at("weeks", F.col("week_start"))).filter(F.col("flags").isNotNull())
        return found.select(*rows.columns, "flags.*")

    def weekly_table(
        self,
        as_of: date,
        by: Sequence[str] = (),
        cuts: Mapping[str, str | None] | None = None,
        periods_back: int = 260,
        lookback_weeks: int = 1,
        literal_survival: bool = False,
        min_locations: int | None = None,
    ) -> DataFrame:
        """As :func:`weekly.weekly_table`, without reading an event."""
        spine = weekly._Spine(as_of, periods_back, self.first)
        flows = weekly.job_flows(self.flagged_workers(as_of), spine, lookback_weeks, within=["part"])
        keys = weekly.CUT_KEYS if cuts else tuple(by)
        located = weekly.location_measures(self.location_flags(), spine, keys, literal_survival, cuts)
        parts = located.unionByName(weekly.worker_measures(flows, keys, cuts), allowMissingColumns=True)
        if cuts:
            parts = parts.unionByName(weekly.national_weeks(self.spark, as_of, periods_back, self.first, cuts), allowMissingColumns=True)
        measures = weekly.one_row_per_period(parts, keys)
        return weekly.report_table(measures, as_of, keys, self.first, periods_back, min_locations)
