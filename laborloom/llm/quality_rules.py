"""Quality rules: ordered decision lists learned by sequential covering.

Documents become a few interpretable statistics. Rules that reject are grown
one threshold condition at a time on one part of the labelled rows, pruned on
the other, and the covered rows leave before the next rule is sought. The list
ends up as one Spark conditional expression.

Everything is DataFrame work. A text is reduced to its statistics inside its
row; learning sees counts of (statistic, bin), never rows.

Edge cases: null and empty texts have zero in every statistic and fail the base
rule; ties between conditions go to the first statistic and lowest threshold;
repeated rows each give a row; without labelled rows (or without bad ones) the
list is empty and rejects nothing; further columns pass through untouched
unless a statistic has their name, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import SPACES, crc_mod, let, sample_of, saved, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics the rules may test, each a share or a mean so that length does not decide; null without words or lines,
# where a plain division stops the job.
FEATURES = {
    "symbol_share": lambda: F.try_divide("n_symbols", "word_chars"),
    "dup_line_share": lambda: F.try_divide("n_dup_lines", "n_lines"),
    "repeat_share": lambda: F.try_divide("n_repeat_words", "n_words"),
    "mean_word_chars": lambda: F.try_divide("word_chars", "n_words"),
    "distinct_share": lambda: F.try_divide("n_distinct_words", "n_words"),
    "capital_share": lambda: F.try_divide("n_capitals", "word_chars"),
    "mark_share": lambda: F.try_divide("n_marks", "word_chars"),
    "digit_share": lambda: F.try_divide("n_digits", "word_chars"),
}


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.char_length(F.regexp_replace(text, dropped, "")).cast("long")


def repeated_words(w: Column) -> Column:
    """Words that lie in three-word windows found twice or more in the same list."""
    last = F.size(w) - 2

    def covered(hashes: Column) -> Column:
        n = F.size(hashes)
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Neighbours in hash order are the equal windows; both positions count.
        starts = let(
            ordered,
            lambda s: F.sort_array(
                F.array_distinct(
                    F.flatten(
                        F.filter(
                            F.zip_with(
                                F.slice(s, 1, n - 1),
                                F.slice(s, 2, n - 1),
                                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
                            ),
                            lambda pair: pair.isNotNull(),
                        )
                    )
                )
            ),
        )
        # A window adds three words, or fewer where the next one starts sooner.
        return let(
            starts,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), b - a)),
                F.lit(0),
                lambda total, step: total + F.coalesce(step, F.lit(3)),
            ),
        )

    hashes = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(last > 1, found).otherwise(0).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the counts behind FEATURES; one pass over whole texts, no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")

    def counts(w: Column, rows: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        )

    found = let(words(body), lambda w: let(lines, lambda rows: counts(w, rows)))
    marks = {
        "n_symbols": _kept_chars(body, "[^#*$%&|<>]+"),
        "n_capitals": _kept_chars(body, "[^\\p{Lu}]+"),
        "n_marks": _kept_chars(body, "[^!?;:~^]+"),
        "n_digits": _kept_chars(body, "[^0-9]+"),
    }
    names = ("n_words", "word_chars", "n_repeat_words", "n_distinct_words", "n_lines", "n_dup_lines")
    wide = docs.withColumn("_found", found)
    return wide.withColumns({**{n: F.col("_found")[n] for n in names}, **marks}).drop("_found")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.coalesce(FEATURES[self.feature](), F.lit(0.0))
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def _counts_by_bin(rows: DataFrame, thresholds: dict[str, list[float]], target: str) -> dict:
    """(feature, bin) -> (target rows, other rows); bin k holds values above k of the feature's thresholds."""
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            reduce(lambda a, b: a + b, [(F.col(name) > t).cast("int") for t in cuts]).alias("bin"),
        )
        for name, cuts in thresholds.items()
    ]
    counted = (
        rows.select(target, F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell.feature", "cell.bin")
        .agg(F.sum(F.col(target).cast("long")).alias("hit"), F.sum((~F.col(target)).cast("long")).alias("other"))
    )
    return {(r["feature"], r["bin"]): (r["hit"], r["other"]) for r in counted.collect()}


def _best_condition(cells: dict, thresholds: dict[str, list[float]]) -> Condition | None:
    """The condition of highest information gain over the rows counted in ``cells``."""
    first = next(iter(thresholds))
    total = [sum(v[k] for (name, _), v in cells.items() if name == first) for k in (0, 1)]
    if not total[0] or not total[1]:
        return None
    before, best = log2(total[0] / sum(total)), (1e-9, None)
    for name, cuts in thresholds.items():
        low = [0, 0]
        for k, cut in enumerate(cuts):
            low = [low[j] + cells.get((name, k), (0, 0))[j] for j in (0, 1)]
            for above in (False, True):
                hit, other = (total[0] - low[0], total[1] - low[1]) if above else low
                if hit and (gain := hit * (log2(hit / (hit + other)) - before)) > best[0]:
                    best = (gain, Condition(name, above, cut))
    return best[1]


def learn_rules(
    labelled: DataFrame,
    label: str,
    key: str = "doc_id",
    max_rules: int = 8,
    max_conditions: int = 3,
    bins: int = 64,
    min_precision: float = 0.9,
    min_covered: int = 5,
    fit_rows: int = 100_000,
) -> list[Rule]:
    """Rules, in order, that find rows whose ``label`` is 0; later rules see what earlier ones left.

    ``labelled`` has statistics (with_statistics) and the label. A sample of about ``fit_rows`` rows by the key's hash
    is used: two thirds to grow, a third to prune. A rule is kept when it is right for ``min_precision`` of at least
    ``min_covered`` rows of the pruning part.
    """
    known = labelled.filter(F.col(label).isNotNull())
    sample = saved(
        sample_of(known, key, fit_rows)
        .select(
            (F.col(label) == 0).alias("bad"),
            (crc_mod(key, 3) == 0).alias("prune"),
            *[F.coalesce(make(), F.lit(0.0)).alias(name) for name, make in FEATURES.items()],
        )
        .coalesce(8),
        "rule_sample",
    )
    steps = [k / bins for k in range(1, bins)]
    quantiles = sample.select([F.percentile_approx(n, steps, 20_000).alias(n) for n in FEATURES]).first()
    thresholds = {n: sorted(set(quantiles[n])) for n in FEATURES if quantiles[n]}
    if not thresholds:
        return []

    def test(condition: Condition) -> Column:
        value = F.col(condition.feature)
        return value > condition.threshold if condition.above else value <= condition.threshold

    rules: list[Rule] = []
    left = sample
    while len(rules) < max_rules:
        rule: list[Condition] = []
        rows = left.filter(~F.col("prune"))
        while len(rule) < max_conditions:
            condition = _best_condition(_counts_by_bin(rows, thresholds, "bad"), thresholds)
            if condition is None:
                break
            rule.append(condition)
            rows = rows.filter(test(condition))
        if not rule:
            break
        # Drop trailing conditions that do not help on the rows kept for pruning.
        heads = [reduce(lambda a, b: a & b, map(test, rule[:n])) for n in range(1, len(rule) + 1)]
        found = left.filter("prune").select(
            *[F.count_if(h & F.col("bad")).alias(f"hit{n}") for n, h in enumerate(heads)],
            *[F.count_if(h & ~F.col("bad")).alias(f"other{n}") for n, h in enumerate(heads)],
        ).first()
        worth = [(found[f"hit{n}"], found[f"other{n}"]) for n in range(len(heads))]
        best = max(range(len(heads)), key=lambda n: ((worth[n][0] - worth[n][1]) / max(sum(worth[n]), 1), -n))
        hit, other = worth[best]
        if hit + other < min_covered or hit < min_precision * (hit + other):
            break
        rules.append(tuple(rule[: best + 1]))
        left = left.filter(~heads[best])
    return rules


def deciding_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, 0 for none: the decision list as one conditional expression."""
    decision = None
    for number, rule in enumerate(rules, 1):
        decision = F.when(all_of(rule), number) if decision is None else decision.when(all_of(rule), number)
    return F.lit(0) if decision is None else decision.otherwise(0)


def rate_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", **fit) -> DataFrame:
    """Base counts of every document, whether the base rule fails it, the rejecting rule and the verdict.

    Statistics are computed once and staged in the shared folder; rules are learned from the labelled ones.
    """
    stats = saved(with_statistics(docs.select(key, "text")).drop("text"), "statistics")
    marked = labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    rules = learn_rules(stats.filter(~base_failed()).join(marked, key), "_label", key, **fit)
    return stats.select(
        key,
        *BASE,
        base_failed().alias("base_failed"),
        deciding_rule(rules).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
