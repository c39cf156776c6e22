"""Exact distinct counts of workers that add up: bitmaps over dense worker codes.

A distinct count of days cannot be summed to weeks, nor one of states to the
nation. A bitmap can: worker ``code`` is bit ``code % 64`` of word ``code / 64``,
and the union of two bitmaps is ``bit_or`` of their words. The stored table has one
row for each day, label set and word with a bit set; any roll-up of days and
labels is one aggregate over it, whose buffers are single longs. Spark's own
bitmaps have 4 KB buffers whatever they hold; words stay small where
a day has few workers in a state, and the table is never longer than the list of
distinct workers it replaces.

Codes are dense and clustered: workers of one home (the labels where they are
found) get neighbouring codes, so a state's bits share words. They come from
counts and numbers within small groups of workers, not from one global window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import week_start
from laborloom.sources.sinks import replace_table

LABELS = ("industry", "state")
SPLITS = 16  # groups of workers of one home


def periods(first: str = "sunday") -> dict[str, Column]:
    """First day of the period a day belongs to, by name of the period."""
    day = F.col("event_date")
    return {"day": day, "week": week_start("event_date", first), "month": F.trunc(day, "month")}


def worker_codes(events: DataFrame, home: Sequence[str] = LABELS) -> DataFrame:
    """``user_id`` and ``code``: 0, 1, 2, ... without gaps.

    A worker's group is a hash of the home and of the id, so every count and number depends on the data alone and lost
    tasks can be run again. Starts are summed over one row per group.
    """
    # A hash of the labels is of fixed width, so the aggregate needs no sort; the smallest settles workers with several homes.
    workers = events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min(F.xxhash64(*home)).alias("home"))
    grouped = workers.withColumn("split", F.pmod(F.xxhash64("user_id"), F.lit(SPLITS)))
    group = ["home", "split"]
    sizes = grouped.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("user_id"))
    numbered = grouped.withColumn("place", place).join(starts, group)
    return numbered.select("user_id", (F.col("start") + F.col("place") - 1).alias("code"))


def extended_codes(codes: DataFrame, events: DataFrame, home: Sequence[str] = LABELS) -> DataFrame:
    """``codes`` with codes after the last one for workers that have none yet; stored bitmaps stay right."""
    new = worker_codes(events.join(codes.select("user_id"), "user_id", "left_anti"), home)
    last = codes.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("last"))
    # One row.
    return codes.select("user_id", "code").unionByName(
        new.join(F.broadcast(last)).select("user_id", (F.col("code") + F.col("last") + 1).alias("code"))
    )


def daily_bitmaps(events: DataFrame, codes: DataFrame, by: Sequence[str] = LABELS) -> DataFrame:
    """``event_date``, ``by``, ``word`` and ``bits``: the workers of each day and label set.

    Rows are reduced to one for each day, label set and worker before codes are looked up, so the lookup moves few of
    them and no worker has many.
    """
    seen = events.filter(F.col("user_id").isNotNull()).select("event_date", *by, "user_id").distinct()
    coded = seen.join(codes, "user_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("code") % 64).cast("int"))
    return coded.groupBy("event_date", *by, F.expr("code div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def store_bitmaps(bitmaps: DataFrame, path: str, files_per_partition: int = 8) -> DataFrame:
    """Write daily bitmaps by month; months present replace stored ones, others stay. Returns the whole table."""
    replace_table(bitmaps.withColumn("month", F.trunc("event_date", "month")), path, ["month"], files_per_partition)
    return bitmaps.sparkSession.read.parquet(path).drop("month")


def distinct_workers(bitmaps: DataFrame, period: Column, by: Sequence[str] = ()) -> DataFrame:
    """``period_start``, ``by`` and the number of distinct ``workers``, for any labels among those stored."""
    merged = bitmaps.groupBy(period.alias("period_start"), *by, "word").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy("period_start", *by).agg(F.sum(F.bit_count("bits")).alias("workers"))


def distinct_workers_cube(
    bitmaps: DataFrame, by: Sequence[str] = LABELS, kinds: Mapping[str, Column] | None = None
) -> DataFrame:
    """``period``, ``period_start``, the labels and ``workers``, for every kind of period and every set of labels.

    A label that a row is not split by is NULL, with ``by_<label>`` false. The finest unions, of all labels and each kind
    of period, are made first; coarser ones come from those.
    """
    kinds = kinds or periods()
    starts = F.array(*[F.struct(F.lit(name).alias("period"), start.alias("period_start")) for name, start in kinds.items()])
    # By period and word, which all unions share: rows move once, before label sets multiply them. A number of parts,
    # because a size measured before that says little about the memory of the unions.
    keys = ["period", "period_start", "word"]
    parts = int(bitmaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bitmaps.withColumn("at", F.explode(starts)).select("at.*", *by, "word", "bits").repartition(parts, *keys)
    finest = dealt.groupBy(*keys, *by).agg(F.bit_or("bits").alias("bits"))
    kinds_of = {name: finest.schema[name].dataType for name in by}
    sets = [
        F.struct(
            *[(F.col(name) if chosen >> k & 1 else F.lit(None).cast(kinds_of[name])).alias(name) for k, name in enumerate(by)],
            *[F.lit(bool(chosen >> k & 1)).alias(f"by_{name}") for k, name in enumerate(by)],
        )
        for chosen in range(2 ** len(by))
    ]
    marks = [f"by_{name}" for name in by]
    spread = finest.select(*keys, "bits", F.explode(F.array(*sets)).alias("set")).select(*keys, "bits", "set.*")
    merged = spread.groupBy(*keys, *by, *marks).agg(F.bit_or("bits").alias("bits"))
    shown = ["period", "period_start", *by, *[f"by_{name}" for name in by]]
    return merged.groupBy(*shown).agg(F.sum(F.bit_count("bits")).alias("workers"))
