"""Language identification as mixture inference.

A document is taken to be written in several languages, in unknown
proportions. Character trigrams of a word have a likelihood under each
language; expectation-maximisation finds the proportions that explain all words
of a text best, and the set of languages is chosen by penalised likelihood, one
language more only where it explains clearly more. The prediction is the
language of the largest proportion in that set, the score its proportion.

Trigram counts come from a sample of labelled documents and are summed by
Spark: a table of languages by trigram buckets. Scoring is one pass over whole
texts in Arrow batches, no shuffle; each word of a batch is rated once.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is
every text where no document is labelled; a text whose letters tell nothing
gets the most frequent language; ties go to the language first in code-point
order; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import crc_mod, sample_of

UNKNOWN = "und"
CHUNK_WORDS = 200_000
CHUNK_CHARACTERS = 500_000
BREAK = re.compile(r"\s")


@dataclass(frozen=True)
class Languages:
    """Names in code-point order, log-likelihood of each trigram bucket under each, and how common each is."""

    names: tuple[str, ...]
    grams: np.ndarray
    prior: np.ndarray


def letters_of(codes: np.ndarray) -> np.ndarray:
    """Code points with everything but letters as space (32); beyond Latin the few signs left in do no harm."""
    low = (codes < 0xC0) & ~((codes >= 97) & (codes <= 122))
    return np.where(low | (codes == 0xD7) | (codes == 0xF7) | ((codes >= 0x2000) & (codes < 0x2C00)), 32, codes)


def word_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(trigram bucket, word number) of every trigram of every word, words set in spaces; words without one have none."""
    codes = np.frombuffer(("  ".join(["", *words, ""])).lower().encode("utf-32-le", "replace"), np.uint32)
    # Lower case may change a word's length, so words are counted by the double spaces between them.
    breaks = np.cumsum((codes[:-1] == 32) & (codes[1:] == 32))
    letters = letters_of(codes).astype(np.uint64)
    first, middle, last = letters[:-2], letters[1:-1], letters[2:]
    real = middle != 32
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (middle * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (last * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets))[real].astype(np.int64), (breaks[:-1] - 1)[real]


def parts_of(text: str | None) -> Iterator[str]:
    """A text in parts of about CHUNK_CHARACTERS, cut at white space."""
    text, start = text or "", 0
    while len(text) - start > CHUNK_CHARACTERS:
        found = BREAK.search(text, start + CHUNK_CHARACTERS)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def distinct_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, then (text number, word number, times) of every pair that occurs."""
    known: dict[str, int] = {}
    number, owner, times = [], [], []
    for at, text in enumerate(texts):
        for part in parts_of(text):
            found = np.fromiter((known.setdefault(w, len(known)) for w in part.split()), np.int64)
            found, often = np.unique(found, return_counts=True)
            number.append(found)
            owner.append(np.full(len(found), at))
            times.append(often)
    none = np.zeros(0, np.int64)
    pairs = np.concatenate([none, *owner]) * max(len(known), 1) + np.concatenate([none, *number])
    pairs, place = np.unique(pairs, return_inverse=True)
    total = np.bincount(place, np.concatenate([none, *times]), len(pairs)).astype(np.int64)
    return list(known), pairs // max(len(known), 1), pairs % max(len(known), 1), total


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts with about CHUNK_CHARACTERS together, or one longer text: what is rated at once."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > CHUNK_CHARACTERS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    yield held


def learn_languages(
    labelled: DataFrame, fit_rows: int = 20_000, buckets: int = 1 << 15, smoothing: float = 0.5, most: int = 512
) -> Languages:
    """Counts over about ``fit_rows`` documents (``doc_id, text, lang``) chosen by hash.

    Every task holds languages x buckets numbers. Beyond ``most`` languages there are fewer buckets for each, so that the
    table keeps its size.
    """
    rows = sample_of(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), "doc_id", fit_rows)
    names = sorted(r["lang"] for r in rows.groupBy("lang").count().collect())
    buckets = buckets if len(names) <= most else max(256, buckets * most // len(names))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("lang"):
                for texts in slices(part["text"].tolist()):
                    words, _, word, times = distinct_words(texts)
                    gram, owner = word_grams(words, buckets)
                    weight = np.bincount(word, times, len(words))
                    sums.setdefault(name, np.zeros(buckets))
                    sums[name] += np.bincount(gram, weight[owner], buckets)
        for name, row in sums.items():
            used = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "gram": used, "n": row[used].astype(np.int64)})

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    table = np.zeros((len(names), buckets))
    # At most languages x buckets rows, whatever the corpus.
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    at = {n: k for k, n in enumerate(names)}
    table[found["lang"].map(at).to_numpy(np.int64), found["gram"].to_numpy(np.int64)] = found["n"]
    sizes = table.sum(axis=1, keepdims=True)
    grams = np.log((table + smoothing) / (sizes + smoothing * buckets)).T.astype(np.float32)
    return Languages(tuple(names), np.ascontiguousarray(grams), (sizes[:, 0] + 1) / (sizes.sum() + len(names)))


def mixtures(
    likelihood: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, prior: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (text x language) and log-likelihood of each text, by expectation-maximisation.

    ``likelihood``: word occurrences x languages, each row scaled by a factor of its own; ``text`` is ascending.
    """
    shares = np.tile(prior.astype(np.float32), (texts, 1)) if prior.ndim == 1 else prior.astype(np.float32)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    present = text[starts]
    total = np.add.reduceat(weight, starts)[:, None] if len(starts) else weight[:, None]
    for _ in range(rounds):
        if not len(starts):
            break
        joint = likelihood * shares[text]
        joint *= (weight / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
        shares[present] = np.add.reduceat(joint, starts, axis=0) / total
    logs = np.zeros(texts)
    if len(starts):
        logs[present] = np.add.reduceat(np.log(np.maximum((likelihood * shares[text]).sum(axis=1), 1e-30)) * weight, starts)
    return shares, logs


def infer(texts: list[str | None], model: Languages, rounds: int, penalty: float) -> pd.DataFrame:
    """Predicted language, score, chosen set and proportions of each text."""
    words, text, word, times = distinct_words(texts)
    gram, owner = word_grams(words, model.grams.shape[0])
    rated = np.zeros((len(words), len(model.names)), np.float64)
    counts = np.bincount(owner, minlength=len(words))
    for k in range(len(model.names)):
        rated[:, k] = np.bincount(owner, model.grams[gram, k], len(words))
    # Overlapping trigrams say much the same; a third of their sum keeps words from being too sure.
    rated = (rated - rated.max(axis=1, keepdims=True)) / 3 if len(words) else rated
    told = np.exp(rated).astype(np.float32)
    rows = []
    step = max(1, CHUNK_WORDS * 4 // max(len(model.names), 1))
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    first = 0
    while first < len(texts):
        last = first + 1
        while last < len(texts) and bounds[last + 1] - bounds[first] <= step:
            last += 1
        part = slice(bounds[first], bounds[last])
        rows.append(_infer_part(told, counts, text[part] - first, word[part], times[part], last - first, model, rounds, penalty))
        first = last
    return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame({"lang": [], "score": [], "languages": [], "shares": []})


def _infer_part(told, counts, text, word, times, texts, model, rounds, penalty) -> pd.DataFrame:
    heard = counts[word] > 0
    text, word, times = text[heard], word[heard], times[heard]
    likelihood, weight = told[word], (times * counts[word]).astype(np.float32)
    shares, _ = mixtures(likelihood, text, weight, texts, model.prior, rounds)
    # Candidate sets are nested: the k languages of largest proportion. A text's set grows until that stops paying.
    order = np.argsort(-shares, axis=1, kind="stable")
    length = np.bincount(text, weight, texts)
    best, chosen, kept = np.full(texts, -np.inf), np.ones(texts, np.int64), shares
    growing = np.ones(texts, bool)
    for k in range(1, len(model.names) + 1):
        allowed = np.zeros_like(shares)
        np.put_along_axis(allowed, order[:, :k], np.float32(1), axis=1)
        start = shares * allowed + np.float32(1e-6) * allowed
        start /= start.sum(axis=1, keepdims=True)
        fitted, logs = mixtures(likelihood, text, weight, texts, start, 2 if k > 1 else 0)
        value = logs - penalty * (k - 1) * np.log(np.maximum(length, 2.0))
        better = growing & (value > best)
        growing = better
        best, chosen = np.where(better, value, best), np.where(better, k, chosen)
        kept = np.where(better[:, None], fitted, kept)
        if not growing.any():
            break
    top = kept.argmax(axis=1)
    names = model.names
    return pd.DataFrame(
        {
            "lang": [names[t] for t in top],
            "score": np.clip(kept[np.arange(texts), top].astype(np.float64), 0, 1),
            "languages": [[names[j] for j in order[i, : chosen[i]]] for i in range(texts)],
            "shares": [[float(kept[i, j]) for j in order[i, : chosen[i]]] for i in range(texts)],
        }
    )


RESULT = "lang string, score double, languages array<string>, shares array<double>"


def identify(
    docs: DataFrame,
    model: Languages,
    text: str = "text",
    into: str = "language",
    rounds: int = 12,
    penalty: float = 2.0,
) -> DataFrame:
    """Add column ``into``: struct of lang, score, languages and shares, over whole texts."""
    @F.pandas_udf(RESULT)
    def languages(texts: pd.Series) -> pd.DataFrame:
        return pd.concat([infer(part, model, rounds, penalty) for part in slices(texts.tolist())], ignore_index=True)

    unknown = F.struct(
        F.lit(UNKNOWN).alias("lang"),
        F.lit(0.0).alias("score"),
        F.array().cast("array<string>").alias("languages"),
        F.array().cast("array<double>").alias("shares"),
    )
    if not model.names:
        return docs.withColumn(into, unknown)
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    return docs.withColumn(into, languages(F.col(text))).withColumn(into, F.when(lettered, F.col(into)).otherwise(unknown))


def predict_languages(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Learn from labelled documents outside the held-out part, then rate every document."""
    held_out = crc_mod(key, 4) == 2
    model = learn_languages(docs.filter(~held_out).select(F.col(key).alias("doc_id"), "text", "lang"))
    rated = identify(docs.select(key, "text"), model, **options)
    return rated.select(
        key,
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.languages").alias("languages"),
    )
