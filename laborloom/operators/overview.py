"""Latest-versus-previous snapshot of the six headline metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.functions.ratios import half_up


def latest_two(series: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last two rows of each series, ranked 1 (latest) and 2.

    Report series have one row per period, so this window over an ungrouped
    series sorts a few hundred rows at most.
    """
    newest = Window.partitionBy(*by).orderBy(*[F.desc(name) for name in order])
    return series.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= 2)


EXTRAS = ("pct_above_base", "indexed")


def _cards(pair: DataFrame, specs: Sequence[tuple[str, str, str, str | None, Sequence[str]]]) -> DataFrame:
    """One row per spec (metric, unit, value, change column, extras).

    All cards of a series come from one aggregate, so the series behind it is
    computed once. Without a change column the change is the difference to the
    row before.
    """

    def at(rank: int, name: str) -> Column:
        return F.max(F.when(F.col("recency") == rank, F.col(name).cast("double")))

    measures, entries = [], []
    for i, (metric, unit, value, change, extras) in enumerate(specs):
        move = at(1, change) if change else half_up(at(1, value) - at(2, value), 2)
        measures += [at(1, value).alias(f"value{i}"), move.alias(f"move{i}")]
        measures += [at(1, name).alias(f"{name}{i}") for name in extras]
        missing = F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(metric).alias("metric"),
                F.col(f"value{i}").alias("value"),
                F.lit(unit).alias("unit"),
                F.col(f"move{i}").alias("mom_change"),
                *[(F.col(f"{name}{i}") if name in extras else missing).alias(name) for name in EXTRAS],
            )
        )
    return pair.agg(*measures).select(F.inline(F.array(*entries)))


def overview(labor: DataFrame, national_wages: DataFrame, hiring: DataFrame, turnover: DataFrame) -> DataFrame:
    """Six rows, one per headline metric."""
    index_unit, job_unit = "% vs Jan baseline", "jobs/location"
    cards = [
        _cards(
            latest_two(labor, ["year", "month"]),
            [
                ("employees_working", index_unit, "employees_working_pct", "employees_mom_ppt", ()),
                ("hours_worked", index_unit, "hours_worked_pct", "hours_mom_ppt", ()),
                ("businesses_open", index_unit, "businesses_open_pct", "open_mom_ppt", ()),
            ],
        ),
        _cards(
            latest_two(national_wages, ["period_end"]),
            [("hourly_wages", "$/hr", "wage_rate", None, ("pct_above_base",))],
        ),
        _cards(latest_two(hiring, ["period_end"]), [("jobs_added", job_unit, "per_loc", None, ("indexed",))]),
        _cards(latest_two(turnover, ["period_end"]), [("jobs_archived", job_unit, "per_loc", None, ("indexed",))]),
    ]
    return reduce(lambda left, right: left.unionByName(right), cards)
