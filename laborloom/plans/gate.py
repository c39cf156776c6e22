"""Publication behind a gate: checked while it is written, visible only if sound.

The rows go to a candidate folder beside the table, and the job that writes them
gathers the metrics of all rules as it goes (``Observation``): no second scan.
When every rule holds, the candidate takes the table's place by renaming;
otherwise it is removed and the table stays as it was. With a partition column
only the partitions of the candidate are replaced, one rename each.

Metrics are those of the tasks that wrote the files: a result task counts once,
however often it was tried.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from laborloom.sources.sinks import list_folder, remove_table, rename_table, table_exists


@dataclass(frozen=True)
class Rule:
    """Metrics to gather, and what must hold for them."""

    name: str
    metrics: Mapping[str, Column]
    sound: Callable[[Mapping[str, Any]], bool]


@dataclass(frozen=True)
class Finding:
    rule: str
    sound: bool
    metrics: Mapping[str, Any]


class Rejected(ValueError):
    """A candidate that broke a rule; ``findings`` tell which."""

    def __init__(self, path: str, findings: Sequence[Finding]):
        broken = "; ".join(f"{f.rule} {dict(f.metrics)}" for f in findings if not f.sound)
        super().__init__(f"{path} was not published: {broken}")
        self.findings = list(findings)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def row_count(least: int = 1, most: int | None = None) -> Rule:
    return Rule("row_count", {"rows": F.count(F.lit(1))}, lambda m: least <= m["rows"] and (most is None or m["rows"] <= most))


def weekday_symmetry(column: str = "day_of_week", codes: Sequence[int] = tuple(range(1, 8)), tolerance: float = 0.0) -> Rule:
    """Every weekday has as many rows; they may differ by a share ``tolerance`` of the largest."""
    counts = {f"on_{code}": _count(F.col(column) == code) for code in codes}
    return Rule("weekday_symmetry", counts, lambda m: max(m.values()) - min(m.values()) <= tolerance * max(m.values()))


def days_behind(column: str = "days_with_data", expected: int = 4, tolerance: float = 0.0) -> Rule:
    """Rows rest on ``expected`` days; a share ``tolerance`` of them may not."""
    metrics = {"rows": F.count(F.lit(1)), "short": _count(F.coalesce(F.col(column), F.lit(-1)) != expected), "least": F.min(column), "most": F.max(column)}
    return Rule("days_behind", metrics, lambda m: m["short"] <= tolerance * m["rows"])


def no_missing_days(column: str, first: date, last: date) -> Rule:
    """Every day of the span has a row; one metric for each day, so for spans of months, not decades."""
    days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    return Rule("no_missing_days", {f"on_{day}": _count(F.col(column) == F.lit(day)) for day in days}, lambda m: all(m.values()))


def null_share(column: str, most: float = 0.0) -> Rule:
    metrics = {"rows": F.count(F.lit(1)), "nulls": _count(F.col(column).isNull())}
    return Rule(f"null_share {column}", metrics, lambda m: m["nulls"] <= most * m["rows"])


def within(column: str, low: float, high: float) -> Rule:
    """No value lies outside the range; nulls do not count."""
    value = F.col(column).cast("double")
    return Rule(f"within {column}", {"outside": _count(~value.between(low, high)), "low": F.min(value), "high": F.max(value)}, lambda m: not m["outside"])


def write_observed(df: DataFrame, path: str, rules: Sequence[Rule], partition_by: Sequence[str] = ()) -> list[Finding]:
    """Write the rows and judge the rules by what the writing job has seen."""
    seen = Observation(f"gate-{uuid4().hex}")
    metrics = {f"r{k}.{name}": metric for k, rule in enumerate(rules) for name, metric in rule.metrics.items()}
    observed = df.observe(seen, *[metric.alias(name) for name, metric in metrics.items()])
    observed.write.partitionBy(*partition_by).parquet(path)
    found = seen.get
    findings = []
    for k, rule in enumerate(rules):
        own = {name: found[f"r{k}.{name}"] for name in rule.metrics}
        findings.append(Finding(rule.name, bool(rule.sound(own)), own))
    return findings


def publish(df: DataFrame, path: str, rules: Sequence[Rule], partition_by: str | None = None) -> list[Finding]:
    """Replace the table under ``path`` (or the partitions that ``df`` has) if all rules hold, else raise Rejected."""
    if not rules:
        raise ValueError("a gate needs a rule")
    spark, name = df.sparkSession, path.rstrip("/")
    recover(df, name)
    candidate = f"{name}__candidate-{uuid4().hex}"
    try:
        findings = write_observed(df, candidate, rules, [partition_by] if partition_by else ())
        if not all(f.sound for f in findings):
            raise Rejected(path, findings)
        if partition_by is None or not table_exists(spark, name):
            _take_place(df, candidate, name)
        else:
            for part in list_folder(spark, candidate):
                if part.startswith(f"{partition_by}="):
                    _take_place(df, f"{candidate}/{part}", f"{name}/{part}", f"{name}/_old-{part}")
        return findings
    finally:
        remove_table(spark, candidate)


def _take_place(df: DataFrame, source: str, target: str, aside: str | None = None) -> None:
    spark, aside = df.sparkSession, aside or f"{target}__old"
    if table_exists(spark, target):
        rename_table(spark, target, aside)
    rename_table(spark, source, target)
    remove_table(spark, aside)


def recover(df: DataFrame, path: str) -> None:
    """Undo a publication that ended between its two renames."""
    spark = df.sparkSession
    pairs = [(f"{path}__old", path)]
    if table_exists(spark, path):
        pairs += [(f"{path}/{part}", f"{path}/{part.removeprefix('_old-')}") for part in list_folder(spark, path) if part.startswith("_old-")]
    for aside, target in pairs:
        if table_exists(spark, aside):
            if table_exists(spark, target):
                remove_table(spark, aside)
            else:
                rename_table(spark, aside, target)


def benchmark_rules(
    codes: Sequence[int] = tuple(range(7)), asymmetric: float = 0.0, short: float = 0.0
) -> tuple[Rule, ...]:
    """What the reference table of benchmarks must fulfil before anyone sees it; shares above 0 forgive as many."""
    return row_count(), weekday_symmetry("day_of_week", codes, asymmetric), days_behind(tolerance=short), null_share("location_id")
