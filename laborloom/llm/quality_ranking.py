"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document is a row of numbers: a few shares and means of its text, each spread
over ranges between its quantiles so that a linear score can bend. In a pair of
a good and a bad document the good one is preferred with the logistic of the
score difference. Every labelled document takes part: documents of the more
frequent kind meet those of the other in turn, at least ``pairs`` pairs in all,
and the weights maximise the likelihood of all pairs by Newton's method, whose
sums Spark takes in one job a round. The decision is the cut between the two
kinds that gets most labelled documents right, counted over all of them, and
scores are mapped so that it becomes 0.7.

Features take one pass over whole texts in Arrow batches and are staged. Ranges
lie between quantiles of all labelled documents (percentile_approx, which reads
every row). Tasks and the driver hold one matrix of sums, whatever the rows.

Edge cases: null and empty texts have zero features and a score like any other;
where all labels are of one kind every score is the share of good ones, without
labels it is 1; repeated rows score alike; label
ties of one document count as its smallest label; other columns do not take
part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborloom.llm.common import crc_mod, discard, saved

FEATURES = (
    "words",
    "mean_word",
    "distinct",
    "repeated_pairs",
    "longest_run",
    "symbols",
    "capitals",
    "digits",
    "marks",
    "letters",
    "repeated_lines",
    "mean_line",
    "bars",
)
SYMBOLS = re.compile(r"[#*$%&<>@^~=+\\]")
MARKS = re.compile(r"[!?;:]")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    run = longest = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    count = lambda pattern: len(pattern.findall(text)) / chars
    return [
        float(np.log1p(n)),
        chars / n,
        len(set(words)) / n,
        1 - pairs / max(n - 1, 1),
        longest / n,
        count(SYMBOLS),
        count(CAPITALS),
        count(DIGITS),
        count(MARKS),
        sum(map(len, LETTERS.findall(text))) / chars,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        text.count("|") / n,
    ]


def bent(rows: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """How far each feature has come through each of its ranges, 0 to 1; beyond the ends it goes on."""
    parts = []
    for j in range(rows.shape[1]):
        low, high = knots[j, :-1], knots[j, 1:]
        width = high - low
        step = (rows[:, j : j + 1] - low) / np.where(width > 0, width, 1)
        # A range without width is a step: passed or not.
        parts.append(np.where(width > 0, np.clip(step, 0, 1), (rows[:, j : j + 1] > low).astype(float)))
    return np.concatenate(parts, axis=1)


def fit_preferences(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights that explain why the good document of each sampled pair is preferred: the fit for rows held in memory."""
    rng = np.random.default_rng(seed)
    gap = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    weights, moved = np.zeros(gap.shape[1]), np.zeros(gap.shape[1])
    rate = 1.0 / max((gap**2).sum(axis=1).mean() / 4, 1e-6)
    for _ in range(rounds):
        ahead = weights + 0.9 * moved
        doubt = 1 / (1 + np.exp(np.clip(gap @ ahead, -30, 30)))
        moved = 0.9 * moved + rate * (gap.T @ doubt / len(gap) - ridge * ahead)
        weights = weights + moved
    return weights


def preference_pairs(labelled: DataFrame, key: str, goods: int, bads: int, pairs: int, seed: int) -> DataFrame:
    """``better`` and ``worse``: each document of the more frequent kind with some of the other, dealt evenly by hash."""
    spread = -(-(goods + bads) // 10_000)
    placed = labelled.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), key, "x"), F.lit(spread)))
    sizes = placed.groupBy("good", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("good").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("good", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("good", "bucket").orderBy("x")) - 1
    numbered = placed.withColumn("place", place).join(starts, ["good", "bucket"])
    numbered = numbered.select("good", "x", (F.col("start") + F.col("place")).alias("number"))
    many, few = max(goods, bads), min(goods, bads)
    times, common = -(-pairs // many), goods >= bads
    meets = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    one = numbered.filter(F.col("good") == common).select(F.col("x").alias("one"), "number", meets.alias("turn"))
    one = one.select("one", F.pmod(F.col("number") * times + F.col("turn"), F.lit(few)).alias("number"))
    other = numbered.filter(F.col("good") != common).select(F.col("x").alias("other"), "number")
    # Few documents would be few keys of many rows each; they are sent to all tasks.
    met = one.join(F.broadcast(other) if few <= 20_000 else other, "number")
    names = ("better", "worse") if common else ("worse", "better")
    return met.select(F.col("one").alias(names[0]), F.col("other").alias(names[1]))


def preference_weights(pairs: DataFrame, knots: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of the greatest likelihood that ``better`` is preferred, over all pairs."""
    width = knots.shape[0] * (knots.shape[1] - 1)

    def sums_at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, value, slope, curve = 0, 0.0, np.zeros(width), np.zeros((width, width))
            for batch in batches:
                for first in range(0, len(batch), 5_000):
                    sides = [np.array(batch[c].iloc[first : first + 5_000].tolist(), float) for c in ("better", "worse")]
                    gap = bent(sides[0], knots) - bent(sides[1], knots)
                    ahead = gap @ weights
                    doubt = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
                    n, value = n + len(gap), value - np.logaddexp(0, -ahead).sum()
                    slope += gap.T @ doubt
                    curve += (gap * (doubt * (1 - doubt))[:, None]).T @ gap
            yield pd.DataFrame({"n": [n], "value": [value], "slope": [slope], "curve": [curve.ravel()]})

        parts = pairs.mapInPandas(add, "n long, value double, slope array<double>, curve array<double>").toPandas()
        n = parts["n"].sum()
        slope = np.sum(parts["slope"].tolist(), axis=0) / n - ridge * weights
        curve = np.sum(parts["curve"].tolist(), axis=0).reshape(width, width) / n + ridge * np.eye(width)
        return float(parts["value"].sum() / n - ridge * (weights @ weights) / 2), slope, curve

    weights = np.zeros(width)
    value, slope, curve = sums_at(weights)
    step = np.linalg.solve(curve, slope)
    for _ in range(rounds):
        if np.abs(step).max() < 1e-5:
            break
        found = sums_at(weights + step)
        if found[0] < value - 1e-12:
            step = step / 2  # too far
            continue
        weights, (value, slope, curve) = weights + step, found
        step = np.linalg.solve(curve, slope)
    return weights


def best_cut(worths: DataFrame, goods: int, rows: int) -> float:
    """The ``worth`` of the cut that gets most labelled documents right, midway between its neighbours.

    Right ones are counted at every cut, in ranges of worths whose counts before them come from one row per range.
    """
    ranges = min(256, rows // 10_000 + 1)
    shares = [k / ranges for k in range(1, ranges)]
    edges = sorted({*worths.agg(F.percentile_approx("worth", shares, 10_000)).first()[0]}) if shares else []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col("worth")))
    kinds = [F.sum(F.col("good").cast("long")).alias("goods"), F.sum((~F.col("good")).cast("long")).alias("bads")]
    each = worths.groupBy("worth").agg(*kinds).withColumn("bucket", bucket)
    found = each.groupBy("bucket").agg(F.sum("goods"), F.sum("bads"), F.min("worth"), F.max("worth")).orderBy("bucket").collect()
    starts, passed_goods, passed_bads = [], 0, 0
    for k, (b, g, n, _, _) in enumerate(found):
        starts.append((b, passed_bads - passed_goods, found[k + 1][3] if k + 1 < len(found) else found[k][4] + 1e-6))
        passed_goods, passed_bads = passed_goods + g, passed_bads + n
    plan = worths.sparkSession.createDataFrame(starts, "bucket int, start long, beyond double")
    order = Window.partitionBy("bucket").orderBy("worth")
    cuts = each.join(F.broadcast(plan), "bucket").select(
        "worth",
        (F.col("start") + F.sum(F.col("bads") - F.col("goods")).over(order) + goods).alias("right"),
        F.coalesce(F.lead("worth").over(order), "beyond").alias("next"),
    )
    best = cuts.orderBy(F.col("right").desc(), "worth").first()
    if goods >= best["right"]:
        return found[0][3] - 5e-7  # below all
    return (best["worth"] + best["next"]) / 2


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    pairs: int = 20_000,
    pieces: int = 8,
    at_threshold: float = 0.7,
    seed: int = 3,
) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``at_threshold``) for every document."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    held_out = crc_mod(key, 4) == 2
    rows = saved(docs.select(key, held_out.alias("held_out"), measured("text").alias("x")), "quality_features")
    known = labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_good"))
    labelled = rows.filter(~F.col("held_out")).join(known, key).select(key, "x", (F.col("_good") > 0).alias("good"))
    labelled = saved(labelled, "quality_labelled")
    goods, bads = labelled.agg(F.count(F.when(F.col("good"), 1)), F.count(F.when(~F.col("good"), 1))).first()
    if not goods or not bads:
        share = goods / (goods + bads) if goods + bads else 1.0
        return rows.select(key, "held_out", F.lit(share).alias("score"), F.lit(int(share >= at_threshold)).alias("predicted"))
    shares = [k / pieces for k in range(pieces + 1)]
    edges = labelled.agg(*[F.percentile_approx(F.col("x")[j], shares, 100_000) for j in range(len(FEATURES))]).first()
    knots = np.array([list(e) for e in edges], dtype=float)
    met = saved(preference_pairs(labelled, key, goods, bads, pairs, seed), "quality_pairs")
    weights = preference_weights(met, knots)

    @F.pandas_udf("double")
    def valued(xs: pd.Series) -> pd.Series:
        x = np.array(xs.tolist(), dtype=float).reshape(len(xs), len(FEATURES))
        return pd.Series(bent(x, knots) @ weights)

    worths = saved(labelled.select(valued("x").alias("worth"), "good"), "quality_worths")
    threshold = best_cut(worths, goods, goods + bads)
    discard(met, worths)
    shift = float(np.log(at_threshold / (1 - at_threshold)))

    @F.pandas_udf("double")
    def scored(xs: pd.Series) -> pd.Series:
        x = np.array(xs.tolist(), dtype=float).reshape(len(xs), len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(bent(x, knots) @ weights - threshold + shift, -30, 30))))

    out = rows.select(key, "held_out", scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at_threshold).cast("int"))
