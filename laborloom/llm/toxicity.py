"""Toxicity by weak supervision.

Voters are made from a lexicon: terms (words, and stems of four to six letters)
that labelled toxic documents hold far more often than clean ones, dealt into
many lexicon voters, and pattern voters for several different terms, for their
density, for stems alone and for shouted terms. A generative label model reads
their votes without labels: expectation-maximisation estimates how often each
voter fires on toxic and on clean documents, and voters whose votes still
correlate given the label share their weight. A linear classifier over terms is
trained on the posterior labels; it alone scores documents.

Lexicon, label model and classifier are fitted on a sample of about ``fit_rows``
documents chosen by hash. Documents that share a MinHash value of their
three-word phrases are likely copies of one text; of those with the same label
only the one of the smallest key is fitted on (the smallest text where keys are
equal), so reruns learn the same and a toxic variant of a clean text stays beside
it. Term counts are summed by Spark; the fit holds votes and term numbers of the
sample, not texts. Scoring is one pass over whole texts in Arrow batches, no
shuffle.

Edge cases: null and empty texts get the classifier's value for no terms;
without labelled documents of both kinds every score is the share of toxic
labels (0 where there are none); repeated rows score alike; label ties of one
document count as its largest label; other columns do not take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import crc_mod, let, sample_of, saved, words

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def terms_of(text: str | None) -> set[str]:
    """Lower-case words and their stems (marked *)."""
    found = set(LETTERS.findall(text.lower())) if text else set()
    return found | {w[:n] + "*" for n in STEMS for w in found if len(w) > n}


@dataclass(frozen=True)
class Voters:
    """Groups of lexicon terms, and the patterns over all of them."""

    group: dict[str, int]
    groups: int
    dense: float = 0.02

    @property
    def names(self) -> list[str]:
        return [f"lexicon_{g}" for g in range(self.groups)] + ["two_terms", "many_terms", "dense", "stem", "shouted"]

    def votes(self, text: str | None) -> list[int]:
        words = LETTERS.findall(text) if text else []
        low = [w.lower() for w in words]
        hits = [w for w in low if w in self.group]
        stems = {w[:n] + "*" for n in STEMS for w in low if len(w) > n} & self.group.keys()
        fired = [0] * self.groups
        for term in {*hits, *stems}:
            fired[self.group[term]] = 1
        kinds = len(set(hits) | stems)
        upper = any(w.isupper() and len(w) > 3 and w.lower() in self.group for w in words)
        share = len(hits) / max(len(words), 1)
        return [*fired, int(kinds > 1), int(kinds > 4), int(share > self.dense), int(bool(stems)), int(upper)]


def lexicon(sample: DataFrame, label: str, most_terms: int, least: int, odds: float) -> pd.DataFrame:
    """Terms over-represented in labelled toxic documents, best first: term, toxic and clean document counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch[label], strict=True):
                for term in terms_of(text):
                    sums.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            yield pd.DataFrame([(t, *n) for t, n in sums.items()], columns=["term", "toxic", "clean"])

    counts = sample.select("text", label).mapInPandas(count, "term string, toxic long, clean long")
    sums = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = sample.agg(F.sum(F.col(label)).alias("t"), F.sum(1 - F.col(label)).alias("c")).first()
    ratio = ((F.col("toxic") + 0.5) / ((seen["t"] or 0) + 1)) / ((F.col("clean") + 0.5) / ((seen["c"] or 0) + 1))
    kept = sums.filter((F.col("toxic") >= least) & (ratio >= odds))
    return kept.orderBy(F.col("toxic").desc(), "term").limit(most_terms).toPandas()


@dataclass(frozen=True)
class LabelModel:
    fires_toxic: np.ndarray
    fires_clean: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        def log(p, q):
            return np.log(p / q)

        on, off = log(self.fires_toxic, self.fires_clean), log(1 - self.fires_toxic, 1 - self.fires_clean)
        score = (np.where(votes, on, off) * self.weight).sum(axis=1) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Expectation-maximisation from a first guess of each document's label, with correlations of voters.

    Voters that vote alike nearly always share one vote during the rounds. Then the correlation left between votes given
    the estimated label sets the weights: one over the sum of a voter's squared correlations with all voters.
    """
    votes_alike = (np.abs(correlations(votes)) > 0.95).sum(axis=1)
    shared = 1 / np.maximum(votes_alike, 1)
    believed, rate = start.astype(float), float(np.clip(prior, 0.01, 0.99))
    model = LabelModel(shared, shared, shared, rate)
    for _ in range(rounds):
        toxic, clean = believed.sum(), (1 - believed).sum()
        fires_toxic = np.clip((votes.T @ believed + 0.1) / (toxic + 0.2), 1e-4, 1 - 1e-4)
        fires_clean = np.clip((votes.T @ (1 - believed) + 0.1) / (clean + 0.2), 1e-4, 1 - 1e-4)
        # A voter that fires less on toxic documents than on clean ones tells nothing here.
        model = LabelModel(fires_toxic, fires_clean, np.where(fires_toxic > fires_clean, shared, 0.0), rate)
        fresh = model.posterior(votes)
        moved, believed = np.abs(fresh - believed).max() if len(fresh) else 0.0, fresh
        rate = float(np.clip(believed.mean(), 0.01, 0.99)) if len(fresh) else rate
        if moved < 1e-4:
            break
    rest = votes - (believed[:, None] * model.fires_toxic + (1 - believed[:, None]) * model.fires_clean)
    weight = 1 / np.maximum((correlations(rest) ** 2).sum(axis=1), 1.0)
    return LabelModel(model.fires_toxic, model.fires_clean, np.where(model.weight > 0, weight, 0.0), model.prior)


def correlations(votes: np.ndarray) -> np.ndarray:
    """Correlation of each pair of voters over all documents; voters that never differ have none."""
    rest = votes - votes.mean(axis=0) if len(votes) else votes
    spread = np.sqrt((rest**2).sum(axis=0))
    scale = np.where(spread > 0, spread, 1.0)
    return rest.T @ rest / np.outer(scale, scale)


def fit_linear(rows: list[np.ndarray], size: int, target: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on binary terms with soft targets, by accelerated gradient steps; (weights, bias)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    n = max(len(rows), 1)
    share = float(np.clip(target.mean() if len(target) else 0.5, 1e-3, 1 - 1e-3))
    weights, bias = np.zeros(size), np.log(share / (1 - share))
    moved, rate = np.zeros(size), 4.0 / max(1.0, np.sqrt(np.bincount(column, minlength=max(size, 1)).max() / n * 8))
    for _ in range(rounds):
        ahead = weights + 0.9 * moved
        error = 1 / (1 + np.exp(-np.clip(np.bincount(owner, ahead[column], n) + bias, -30, 30))) - target
        slope = np.bincount(column, error[owner], size) / n + ridge * ahead
        moved = 0.9 * moved - rate * slope
        weights = weights + moved
        bias -= error.mean()
    return weights, float(bias)


def _phrase_hashes(text: Column) -> Column:
    """Hashes of a text's three-word phrases, the material of one MinHash value."""
    return let(
        words(text),
        lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, 3))),
    )


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    fit_rows: int = 12_000,
    most_terms: int = 1_000,
    least: int = 6,
    odds: float = 20.0,
    voters: int = 24,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    held_out = crc_mod(key, 5) == 0
    known = labels.filter(F.col(label).isNotNull() & ~held_out).groupBy(key).agg(F.max(label).alias("_toxic"))
    marked = docs.select(key, "text").join(sample_of(known, key, fit_rows), key)
    # A group of copies would teach its own rare words: of each likely group and label the smallest key stays.
    alike = F.coalesce(F.array_min(_phrase_hashes(F.col("text"))), F.xxhash64(key))
    firsts = marked.groupBy(alike.alias("_alike"), "_toxic").agg(F.min(F.struct(key, "text")).alias("first"))
    sample = saved(firsts.select("first.text", "_toxic").repartition(16, "text"), "toxicity_sample")
    terms = lexicon(sample, "_toxic", most_terms, least, odds)
    seen = sample.agg(F.avg("_toxic")).first()[0]
    prior = float(seen or 0.0)
    if terms.empty or prior in (0.0, 1.0):
        score = F.lit(prior)
        return docs.select(key, held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    # Strong terms are dealt round, so that each voter has some that occur.
    term_id = {t: k for k, t in enumerate(terms["term"])}
    jury = Voters({t: k % voters for t, k in term_id.items()}, min(voters, len(term_id)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "votes": [jury.votes(t) for t in batch["text"]],
                    "terms": [sorted(term_id[x] for x in terms_of(t) & term_id.keys()) for t in batch["text"]],
                }
            )

    # About fit_rows rows of term numbers and votes; labels do not come along.
    read_rows = sample.select("text").mapInPandas(read, "votes array<int>, terms array<int>").toPandas()
    # In an order of their own: sums of doubles depend on it.
    read_rows = read_rows.iloc[sorted(range(len(read_rows)), key=lambda i: (list(read_rows["votes"][i]), list(read_rows["terms"][i])))]
    votes = np.array(read_rows["votes"].tolist(), dtype=float)
    model = fit_label_model(votes, votes.mean(axis=1) > 0.5 / len(jury.names), prior)
    rows = [np.asarray(t, np.int64) for t in read_rows["terms"]]
    weights, bias = fit_linear(rows, len(term_id), model.posterior(votes))
    value = {t: float(weights[k]) for t, k in term_id.items()}

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        sums = np.array([bias + sum(value[t] for t in terms_of(x) & value.keys()) for x in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    scored = docs.select(key, held_out.alias("held_out"), toxic("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
