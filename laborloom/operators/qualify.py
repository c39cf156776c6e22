"""Weekly qualification of locations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from laborloom.functions.calendar import week_start
from laborloom.functions.ratios import ratio


@dataclass(frozen=True)
class QualRule:
    """Size range, weeks of activity and wage cover a location-week must reach."""

    name: str
    min_size: float = 5
    max_size: float = 100
    min_weeks: int = 12
    min_wage_cover: float | None = None

    @property
    def column(self) -> str:
        return f"qualified_for_{self.name}"

    def flag(self) -> Column:
        ok = (
            F.col("employees_12w_avg").between(self.min_size, self.max_size)
            & (F.col("weeks_active_52w") >= self.min_weeks)
            & (F.col("archived_this_week") == 0)
        )
        if self.min_wage_cover is not None:
            ok = ok & (F.col("wage_coverage_ratio") > self.min_wage_cover)
        return F.when(ok, 1).otherwise(0).alias(self.column)


# The five published qualification rules.
RULES = (
    QualRule("jobs"),
    QualRule("turnover", min_size=10),
    QualRule("hours"),
    QualRule("wages", min_wage_cover=0.5),
    QualRule("outlook", min_weeks=26),
)


def user_weeks(
    timeclock: DataFrame,
    by: Sequence[str] = (),
    first: str = "sunday",
    wage_band: tuple[float, float] = (7.25, 100),
) -> DataFrame:
    """One row per location, week and worker with every additive measure.

    This is the only aggregate over raw events the weekly metrics need. Its key
    contains the worker, so a very large location spreads over many tasks and
    map-side partial aggregation collapses repeated shifts before the shuffle.
    ``by`` names location attributes such as state, city or msa. They widen the key, which keeps the aggregate's buffers
    of fixed width (a hash aggregate, no sort of events); a worker has several rows in the week in which a label changes.
    """
    hours, rate, pay = F.col("hours_worked"), F.col("hourly_wage_rate"), F.col("total_wages_earned")
    payable = pay.isNotNull() & hours.isNotNull() & rate.between(*wage_band)
    week = week_start("event_date", first)
    closing = week_start(F.col("loc_archived_at").cast("date"), first) == week
    last_day = [F.max(F.unix_date("event_date")).alias("last_day")] if by else []
    return (
        timeclock.filter(F.col("location_id").isNotNull() & F.col("event_date").isNotNull())
        .groupBy("location_id", week.alias("week_start"), "user_id", *by)
        .agg(
            F.count("shift_id").alias("shift_rows"),
            F.sum(F.when(F.col("shift_id").isNotNull(), hours)).alias("shift_hours"),
            F.sum(hours).alias("hours"),
            F.sum(F.when(rate.isNotNull(), hours)).alias("rated_hours"),
            F.sum(F.when(payable, pay)).alias("pay"),
            F.sum(F.when(payable, hours)).alias("pay_hours"),
            F.count(F.when(payable, 1)).alias("pay_rows"),
            F.max(F.when(closing, 1).otherwise(0)).alias("closing"),
            *last_day,
        )
    )


def location_labels(weeks: DataFrame, by: Sequence[str], apart: bool = False) -> DataFrame:
    """The ``by`` labels of each location-week: those of its latest day, the largest of equals.

    With ``apart`` each label is settled by itself. Days are first reduced to one number for each set of labels, so only
    about one narrow row for a location-week meets the comparison of whole labels.
    """
    days = weeks.groupBy("location_id", "week_start", *by).agg(F.max("last_day").alias("last_day"))
    groups = [[name] for name in by] if apart else [list(by)]
    latest = [F.max(F.struct("last_day", *group)).alias(f"latest_{k}") for k, group in enumerate(groups)]
    chosen = [F.col(f"latest_{k}")[name].alias(name) for k, group in enumerate(groups) for name in group]
    return days.groupBy("location_id", "week_start").agg(*latest).select("location_id", "week_start", *chosen)


def location_weeks(weeks: DataFrame, by: Sequence[str] = (), apart: bool = False) -> DataFrame:
    """Location-week totals of :func:`user_weeks`, with the labels of :func:`location_labels`.

    Workers are unique per location-week, so plain counts replace distinct
    counts; with ``by`` the rows of a worker are added up first, in the same
    shuffle.
    """
    keys = ["location_id", "week_start"]
    if by:
        measures = ("hours", "rated_hours", "pay", "pay_hours", "shift_rows")
        sums = [F.sum(name).alias(name) for name in measures]
        # By location and week, which serves both aggregates.
        weeks, split = weeks.repartition(*keys).groupBy(*keys, "user_id").agg(*sums, F.max("closing").alias("closing")), weeks
    totals = weeks.groupBy(*keys).agg(
        F.count("user_id").alias("weekly_employees"),
        F.sum("hours").alias("hours"),
        F.sum("rated_hours").alias("rated_hours"),
        F.sum("pay").alias("pay"),
        F.sum("pay_hours").alias("pay_hours"),
        F.sum("shift_rows").alias("shift_rows"),
        F.sum(F.when(F.col("user_id").isNotNull(), F.col("shift_rows"))).alias("user_shift_rows"),
        F.max("closing").alias("archived_this_week"),
    )
    return totals.join(location_labels(split, by, apart), keys) if by else totals


def history_window() -> WindowSpec:
    """Per location, ordered by the week's day number so that day ranges work.

    The number is a real column: windows that share it share one sort.
    """
    return Window.partitionBy("location_id").orderBy("week_no")


def qualified_weeks(
    totals: DataFrame,
    rules: Sequence[QualRule] = RULES,
    frame: str = "rows",
) -> DataFrame:
    """Add rolling size, activity, wage cover and one flag per rule.

    ``frame="rows"`` counts the location's own active weeks (the published
    rule); ``frame="calendar"`` uses calendar weeks and treats absent weeks as
    zero employees.
    """
    totals = totals.withColumn("week_no", F.unix_date("week_start"))
    history = history_window()
    if frame == "rows":
        size = F.avg("weekly_employees").over(history.rowsBetween(-11, 0))
        active = F.count(F.lit(1)).over(history.rowsBetween(-51, 0))
    elif frame == "calendar":
        size = F.sum("weekly_employees").over(history.rangeBetween(-77, 0)) / 12
        active = F.count(F.lit(1)).over(history.rangeBetween(-357, 0))
    else:
        raise ValueError(f"frame is 'rows' or 'calendar', not {frame!r}")
    rolled = totals.select(
        "*",
        size.alias("employees_12w_avg"),
        active.alias("weeks_active_52w"),
        ratio("rated_hours", "hours").alias("wage_coverage_ratio"),
    )
    return rolled.select("*", *[rule.flag() for rule in rules])


def location_flags(
    timeclock: DataFrame, rules: Sequence[QualRule] = RULES, first: str = "sunday", frame: str = "rows"
) -> DataFrame:
    """Qualification table: one row per location and week."""
    totals = location_weeks(user_weeks(timeclock, first=first))
    return qualified_weeks(totals, rules=rules, frame=frame)
