"""Weekly workforce table: job flows, hours, pay, outlook and survival.

Shape of the plan. Raw events are reduced once to location-week-worker rows.
From those, location-week totals get the qualification flags through windows
on the location, and everything that adds up per location is finished there,
including the look-ahead metrics: the following four weeks and the same week a
year later are range frames on the same window, not joins. Metrics about
workers join the flags back by equality on (location, week) and use one more
window per (location, worker). No event row ever meets a date range join.

Labels (``by``) take part in no window: locations qualify, gain and lose
workers and survive as locations, and a location-week counts under the label it
has then. A worker is first seen once, anywhere.

``cuts`` gives several tables in one pass: national, by state and so on share
the aggregate over events, the location windows and the worker windows; only
what those have reduced is counted once for each cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborloom.functions.calendar import week_start, weekly_spine
from laborloom.functions.ratios import half_up, rounded_ratio
from laborloom.operators.qualify import RULES, QualRule, history_window, location_weeks, qualified_weeks, user_weeks
from laborloom.operators.reuse import computed_once
from laborloom.periods import week_floor

WEEK, YEAR = 7, 364

# Cut name -> location attribute, None for all locations together.
CUTS: dict[str, str | None] = {"national": None, "state": "state", "msa": "msa", "city": "city"}
CUT_KEYS = ("segmented_by", "segment")


class _Spine:
    """First and last complete week of the report as literals."""

    def __init__(self, as_of: date, periods_back: int, first: str):
        self.first_week = week_floor(as_of - timedelta(days=7 * periods_back), first)
        last = week_floor(as_of, first)
        self.last_week = last if last + timedelta(days=6) <= as_of else last - timedelta(days=7)

    def holds(self, week: Column) -> Column:
        return week.between(F.lit(self.first_week), F.lit(self.last_week))


def _is(flag: str) -> Column:
    return F.col(f"qualified_for_{flag}") == 1


def _in_each_cut(rows: DataFrame, cuts: Mapping[str, str | None] | None) -> DataFrame:
    """Each row once for each cut, its label in place of the attributes; unchanged without cuts."""
    if not cuts:
        return rows
    labels = [
        F.struct(F.lit(name).alias("segmented_by"), (F.lit(name) if column is None else F.col(column).cast("string")).alias("segment"))
        for name, column in cuts.items()
    ]
    spread = rows.withColumn("cut", F.explode(F.array(*labels)))
    return spread.withColumns({key: F.col(f"cut.{key}") for key in CUT_KEYS}).drop("cut", *[c for c in cuts.values() if c])


def location_measures(
    flagged: DataFrame,
    spine: _Spine,
    by: Sequence[str] = (),
    literal_survival: bool = False,
    cuts: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Per period: everything that adds up over locations.

    A location-week contributes to its own period and, when it is an outlook
    location, as a survival base to the period 52 weeks later.
    """
    history = history_window()
    ahead = flagged.select(
        "*",
        F.sum("shift_rows").over(history.rangeBetween(WEEK, 4 * WEEK)).alias("ahead_rows"),
        F.max("qualified_for_outlook").over(history.rangeBetween(YEAR, YEAR)).alias("outlook_later"),
    )
    survived = F.col("outlook_later") == 1
    base = F.when(_is("outlook") & survived, 1) if literal_survival else F.when(_is("outlook"), 1)
    lanes = F.when(_is("outlook") & spine.holds(F.col("week_start")), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    rows = _in_each_cut(ahead.withColumn("lane", F.explode(lanes)), cuts)
    now = F.col("lane") == 0
    later = F.col("lane") == 1

    def total(condition: Column, value: Column | str) -> Column:
        return F.sum(F.when(now & condition, F.col(value) if isinstance(value, str) else value))

    has_future = F.col("ahead_rows") > 0
    return rows.groupBy(
        *by, F.when(now, F.col("week_start")).otherwise(F.date_add("week_start", YEAR)).alias("period_start")
    ).agg(
        F.count(F.when(now, 1)).alias("seen_locations"),
        F.count(F.when(now & _is("hours"), 1)).alias("qualified_locations"),
        F.sum(F.when(now, F.col("user_shift_rows"))).alias("user_shift_rows"),
        total(_is("hours"), "hours").alias("hours_total"),
        total(_is("wages"), "rated_hours").alias("hours_rated"),
        total(_is("wages"), "pay").alias("pay_total"),
        total(_is("wages"), "pay_hours").alias("pay_hours"),
        total(_is("outlook"), "shift_rows").alias("shifts_now"),
        F.count(F.when(now & _is("outlook") & (F.col("shift_rows") > 0), 1)).alias("locations_now"),
        total(_is("outlook"), "ahead_rows").alias("shifts_ahead"),
        F.count(F.when(now & _is("outlook") & has_future, 1)).alias("locations_ahead"),
        F.count(F.when(later & base.isNotNull(), 1)).alias("survival_base"),
        F.count(F.when(later & survived, 1)).alias("survivors"),
    )


def archive_marks(timeclock: DataFrame, as_of: date, first: str = "sunday") -> DataFrame:
    """Distinct (location, worker, week of archiving) before ``as_of``."""
    left = F.col("archived_at")
    return (
        timeclock.filter(left.isNotNull() & (left < F.lit(as_of)) & F.col("user_id").isNotNull())
        .filter(F.col("location_id").isNotNull())
        .select("location_id", week_start(left.cast("date"), first).alias("week_start"), "user_id")
        .distinct()
    )


def _with_flags(rows: DataFrame, flagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach labels and the flags worker metrics use, on an equality key."""
    wanted = flagged.filter(_is("jobs") | _is("turnover") | _is("wages"))
    flags = ("qualified_for_jobs", "qualified_for_turnover", "qualified_for_wages")
    return rows.join(wanted.select("location_id", "week_start", *by, *flags), ["location_id", "week_start"])


def _by_worker(rows: DataFrame) -> DataFrame:
    """Rows of a worker in one place, which serves the job flows, the first weeks and the counts of workers.

    They move once, before lanes and cuts multiply them. A number of parts, because a size measured before that says
    little about the tasks.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")


def job_flows(flagged_users: DataFrame, spine: _Spine, lookback_weeks: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Mark workers that are new to, or gone from, a location this week.

    A (worker, location) pair is new when the pair has no qualified shift in
    the preceding ``lookback_weeks``; it is gone in the week after its last
    one. Both looks are seven-day range frames on one window, and weeks before
    the spine do not count as preceding weeks. ``within`` names columns that
    depend on the pair alone and that the rows are already partitioned by.
    """
    at_work = _is("jobs") & (F.col("shift_rows") > 0) & spine.holds(F.col("week_start"))
    marked = flagged_users.withColumn("pair", F.when(at_work, 1))
    pairs = Window.partitionBy("user_id", "location_id", *within).orderBy(F.unix_date("week_start"))
    before = F.max("pair").over(pairs.rangeBetween(-WEEK * lookback_weeks, -WEEK))
    after = F.max("pair").over(pairs.rangeBetween(WEEK, WEEK))
    return marked.select(
        "*",
        (F.col("pair").isNotNull() & before.isNull()).alias("joined"),
        (F.col("pair").isNotNull() & after.isNull()).alias("leaves_next"),
    )


def worker_measures(
    flows: DataFrame, by: Sequence[str] = (), cuts: Mapping[str, str | None] | None = None, debuts: bool = True
) -> DataFrame:
    """Per period: distinct-worker counts.

    Rows are first reduced to one per (period, worker), so each count below is
    a plain sum and no multi-way distinct expansion is needed. ``debuts=False`` leaves out ``workers_new``, the one
    count that depends on a worker's whole history.
    """
    lanes = F.when(F.col("leaves_next"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = _is("turnover") & ~F.col("archive_mark")
    debut = {}
    if debuts:
        # Once per worker (in each cut), anywhere: the earliest week, and the smallest label where a worker is first seen
        # in two. Taken before lanes and cuts multiply the rows, over the order the job flows have left.
        labels = {name: [column] if column else [] for name, column in cuts.items()} if cuts else {"": list(by)}
        worker = Window.partitionBy("user_id")
        for k, (name, label) in enumerate(labels.items()):
            week = F.struct("week_start", *[F.col(c).cast("string") if cuts else F.col(c) for c in label])
            first = F.min(F.when(seen, week)).over(worker)
            debut[f"debut_{k}"] = (name, F.coalesce(seen & (week == first), F.lit(False)))
    marked = flows.select("*", *[flag.alias(name) for name, (_, flag) in debut.items()])
    rows = _in_each_cut(marked.withColumn("lane", F.explode(lanes)), cuts)
    now = F.col("lane") == 0

    def ever(condition: Column) -> Column:
        return F.max(F.when(condition, 1).otherwise(0))

    first_seen_now = F.lit(False)
    for flag, (name, _) in debut.items():
        first_seen_now = first_seen_now | (F.col(flag) & (F.col(CUT_KEYS[0]) == name if cuts else F.lit(True)))
    worker_period = rows.groupBy(
        *by, F.when(now, F.col("week_start")).otherwise(F.date_add("week_start", WEEK)).alias("period_start"), "user_id"
    ).agg(
        ever(now & _is("turnover") & (F.col("shift_rows") > 0)).alias("active"),
        ever(now & F.col("joined")).alias("added"),
        ever(~now).alias("gone"),
        ever(now & _is("turnover") & F.col("archive_mark")).alias("archived"),
        ever(now & _is("wages") & (F.col("pay_rows") > 0)).alias("paid"),
        F.sum(F.when(now & F.col("joined"), F.col("shift_hours"))).alias("new_hours"),
        *([ever(now & first_seen_now).alias("first_week")] if debuts else []),
    )
    return (
        worker_period.groupBy(*by, "period_start")
        .agg(
            F.sum("active").alias("active_workers"),
            F.sum("added").alias("workers_added"),
            F.sum("gone").alias("workers_gone"),
            *([F.sum("first_week").alias("workers_new")] if debuts else []),
            F.sum("archived").alias("workers_archived"),
            F.sum("paid").alias("workers_paid"),
            F.sum("new_hours").alias("hours_new"),
        )
    )


def first_seen(flagged_users: DataFrame, by: Sequence[str] = (), cuts: Mapping[str, str | None] | None = None) -> DataFrame:
    """``user_id``, ``first_week`` and the label there, for every worker (in each cut) seen at a turnover location.

    The earliest week, and the smallest label where a worker is first seen in two.
    """
    seen = flagged_users.filter(_is("turnover") & ~F.col("archive_mark"))
    rows = _in_each_cut(seen, cuts).groupBy(*by, "user_id").agg(F.min("week_start").alias("first_week"))
    whole = [CUT_KEYS[0]] if cuts else []
    if not by:
        return rows
    inner = [name for name in by if name not in whole]
    earliest = rows.groupBy(*whole, "user_id").agg(F.min(F.struct("first_week", *inner)).alias("m"))
    return earliest.select(*whole, "user_id", "m.*")


def worker_rows(weeks: DataFrame, marks: DataFrame) -> DataFrame:
    """Worker-weeks and archiving marks as one table."""
    return (
        weeks.filter(F.col("user_id").isNotNull())
        .select("location_id", "week_start", "user_id", "shift_rows", "shift_hours", "pay_rows")
        .withColumn("archive_mark", F.lit(False))
        .unionByName(marks.withColumn("archive_mark", F.lit(True)), allowMissingColumns=True)
    )


def one_row_per_period(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts that have some of the measures each, one row per period and part, side by side."""
    names = [name for name in parts.columns if name not in (*by, "period_start")]
    return parts.groupBy(*by, "period_start").agg(*[F.max(name).alias(name) for name in names])


def national_weeks(spark: SparkSession, as_of: date, periods_back: int, first: str, cuts: Mapping[str, str | None]) -> DataFrame:
    """The weeks of the spine under each national cut, which has a row for every week."""
    spine = weekly_spine(spark, as_of, periods_back, first)
    names = F.array(*[F.lit(name) for name, column in cuts.items() if column is None]).cast("array<string>")
    return spine.select(F.explode(names).alias("segmented_by"), "period_start").select(
        "segmented_by", F.col("segmented_by").alias("segment"), "period_start"
    )


def period_measures(
    timeclock: DataFrame,
    as_of: date,
    by: Sequence[str] = (),
    first: str = "sunday",
    periods_back: int = 260,
    lookback_weeks: int = 1,
    rules: Sequence[QualRule] = RULES,
    frame: str = "rows",
    literal_survival: bool = False,
    cuts: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Raw weekly measures per period, before ratios and the report spine; with ``cuts`` per cut, label and period."""
    spine = _Spine(as_of, periods_back, first)
    labels = sorted({column for column in cuts.values() if column}) if cuts else list(by)
    weeks = computed_once(user_weeks(timeclock, labels, first), "user-weeks")
    located_weeks = location_weeks(weeks, labels, apart=bool(cuts))
    flagged = computed_once(qualified_weeks(located_weeks, rules, frame), "location-weeks")
    rows = worker_rows(weeks, archive_marks(timeclock, as_of, first))
    flows = job_flows(_by_worker(_with_flags(rows, flagged, labels)), spine, lookback_weeks)
    by = CUT_KEYS if cuts else by
    located = location_measures(flagged, spine, by, literal_survival, cuts)
    workers = worker_measures(flows, by, cuts)
    merged = located.unionByName(workers, allowMissingColumns=True)
    if cuts:
        every = national_weeks(timeclock.sparkSession, as_of, periods_back, first, cuts)
        merged = merged.unionByName(every, allowMissingColumns=True)
    # Both sides are already period aggregates.
    return one_row_per_period(merged, by)


def weekly_table(
    timeclock: DataFrame,
    as_of: date,
    by: Sequence[str] = (),
    first: str = "sunday",
    periods_back: int = 260,
    lookback_weeks: int = 1,
    rules: Sequence[QualRule] = RULES,
    frame: str = "rows",
    literal_survival: bool = False,
    min_locations: int | None = None,
    cuts: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """The weekly table: one row per complete week, or per week and ``by`` key.

    Without ``by`` every week of the spine appears, with NULLs where nothing
    happened; with ``by`` only combinations that have activity do. For
    publication ``min_locations`` drops rows with fewer qualified locations.

    ``cuts`` (such as CUTS, instead of ``by``) stacks several tables, told apart by ``segmented_by`` and ``segment``.
    """
    if by and cuts:
        raise ValueError("give by or cuts, not both")
    measures = period_measures(
        timeclock, as_of, by, first, periods_back, lookback_weeks, rules, frame, literal_survival, cuts
    )
    return report_table(measures, as_of, CUT_KEYS if cuts else by, first, periods_back, min_locations)


def report_table(
    measures: DataFrame,
    as_of: date,
    by: Sequence[str] = (),
    first: str = "sunday",
    periods_back: int = 260,
    min_locations: int | None = None,
) -> DataFrame:
    """The weekly table from its measures: at most one row per week and key, so cheap to derive whenever they change."""
    spine = (
        weekly_spine(measures.sparkSession, as_of, periods_back, first)
        .filter(F.col("period_start") >= F.lit(as_of - timedelta(days=7 * periods_back)))
        .select("period_start", "period_end")
    )
    # The 12-week mean needs the weeks before the report history too, so it is
    # taken on the measures; they are at most one row per week and key.
    bounds = _Spine(as_of, periods_back, first)
    in_spine = measures.filter(bounds.holds(F.col("period_start")))
    has_workers = F.coalesce(F.col("user_shift_rows") > 0, F.lit(False))
    ready = in_spine.withColumn("has_workers", has_workers).withColumn(
        "active_users", F.when(has_workers, F.coalesce("active_workers", F.lit(0)))
    )
    trailing = Window.partitionBy(*by, "has_workers").orderBy("period_start").rowsBetween(-11, 0)
    rolled = ready.withColumn(
        "rolling_users", F.when(F.col("has_workers"), F.sum("active_users").over(trailing).cast("double") / 12)
    )
    joined = spine.join(rolled, "period_start", "inner" if by else "left")
    report = _report_columns(joined, by)
    if min_locations is not None:
        report = report.filter(F.col("active_location_count") >= min_locations)
    return report


def _report_columns(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def money(name: str) -> Column:
        return half_up(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), 2)

    # A period without events has no location row at all, hence NULL not 0.
    active = F.when(F.col("seen_locations") > 0, F.col("qualified_locations"))
    net = zero("workers_added") - zero("workers_gone")
    churn = zero("workers_new") + zero("workers_archived")
    return joined.select(
        *by,
        "period_start",
        "period_end",
        active.alias("active_location_count"),
        "active_users",
        half_up("rolling_users", 2).alias("avg_active_users_12w"),
        zero("shifts_now").alias("total_shifts"),
        zero("workers_added").alias("jobs_added"),
        zero("workers_gone").alias("jobs_archived"),
        zero("workers_new").alias("users_added"),
        zero("workers_archived").alias("users_archived"),
        money("hours_total").alias("hours_worked"),
        money("hours_rated").alias("hours_worked_with_wage"),
        money("hours_new").alias("hours_new_jobs"),
        zero("shifts_ahead").alias("future_shifts"),
        zero("locations_ahead").alias("future_locs"),
        F.when(F.col("pay_total").isNotNull(), rounded_ratio("pay_total", "pay_hours")).alias("avg_nominal_wage"),
        F.when(F.col("pay_total").isNotNull(), rounded_ratio("pay_total", "workers_paid")).alias("avg_weekly_pay"),
        zero("survivors").alias("surviving_businesses_this_week"),
        zero("survival_base").alias("surviving_businesses_last_52w"),
        rounded_ratio("hours_total", active).alias("avg_hours_worked_per_loc"),
        rounded_ratio("hours_rated", active).alias("avg_hours_wage_per_loc"),
        rounded_ratio("workers_added", active).alias("avg_jobs_added_per_loc"),
        rounded_ratio("workers_gone", active).alias("avg_jobs_archived_per_loc"),
        rounded_ratio(net, active).alias("avg_net_jobs_added_per_loc"),
        rounded_ratio("shifts_now", active).alias("shifts_per_loc"),
        rounded_ratio("hours_total", "active_users").alias("hours_worked_per_user"),
        rounded_ratio("hours_total", "shifts_now").alias("hours_worked_per_shift"),
        rounded_ratio("active_users", active).alias("employees_per_loc"),
        rounded_ratio("shifts_ahead", "shifts_now").alias("future_shift_growth"),
        rounded_ratio("locations_ahead", "locations_now").alias("future_loc_growth"),
        rounded_ratio("workers_archived", "rolling_users").alias("turnover_rate"),
        rounded_ratio("workers_new", "rolling_users").alias("hire_rate"),
        rounded_ratio(churn, "rolling_users").alias("turnover_volatility_idx"),
    )


def survival_rate(weekly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of last year's locations that are still active."""
    return weekly.select(
        *by,
        "period_start",
        "period_end",
        "surviving_businesses_this_week",
        "surviving_businesses_last_52w",
        rounded_ratio("surviving_businesses_this_week", "surviving_businesses_last_52w", 4).alias("survival_rate"),
    )


def weekly_change(weekly: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(this week - last week) / last week for each metric."""
    order = Window.partitionBy(*by).orderBy("period_start")
    columns = []
    for name in metrics:
        value = F.col(name).cast("double")
        last = F.lag(value).over(order)
        columns += [F.col(name), half_up((value - last) / F.nullif(last, F.lit(0.0)), 4).alias(f"{name}_change")]
    return weekly.select(*by, "period_start", *columns)
