"""The learned models against plain fits on small inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from laborloom.llm import language_id, quality_ranking, toxicity


def plain_mixture(rows, start, rounds):
    """Proportions of one text by expectation-maximisation, word by word."""
    shares = list(start)
    for _ in range(rounds):
        sums, total = [0.0] * len(shares), 0.0
        for likelihood, weight in rows:
            joint = [p * s for p, s in zip(likelihood, shares)]
            for j, x in enumerate(joint):
                sums[j] += weight * x / sum(joint)
            total += weight
        shares = [s / total for s in sums]
    value = sum(w * math.log(sum(p * s for p, s in zip(likelihood, shares))) for likelihood, w in rows)
    return shares, value


def test_language_mixtures_are_those_of_plain_em():
    rng = np.random.default_rng(1)
    texts, langs = 12, 6
    text = np.sort(rng.integers(0, texts, 300))
    likelihood = rng.random((300, langs)) ** 3 + 1e-3
    likelihood /= likelihood.max(axis=1, keepdims=True)
    weight, prior = rng.integers(1, 5, 300).astype(np.float32), rng.dirichlet(np.ones(langs))
    shares, logs = language_id.mixtures(likelihood.astype(np.float32), text, weight, texts, prior, 15)
    for t in set(text.tolist()):
        rows = [(likelihood[i].tolist(), float(weight[i])) for i in np.flatnonzero(text == t)]
        want, value = plain_mixture(rows, prior, 15)
        assert shares[t] == pytest.approx(want, abs=2e-3)
        assert logs[t] == pytest.approx(value, rel=1e-3, abs=1e-2)


def test_language_sets_grow_beyond_four(spark):
    rng = np.random.default_rng(2)
    letters = "bcdfghjklmnpqrstvwxz"
    own = {f"l{k}": [a + v + b for a in letters[2 * k : 2 * k + 2] for v in "aeiou" for b in letters[2 * k : 2 * k + 2]] for k in range(7)}
    draw = lambda name, n: " ".join(rng.choice(own[name], n))
    made = [(i, draw(f"l{i % 7}", 80), f"l{i % 7}") for i in range(140)]
    model = language_id.learn_languages(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    mixed = " ".join(draw(name, 120) for name in list(own)[:6])
    found = language_id.infer([mixed, draw("l6", 50)], model, 12, 2.0)
    assert sorted(found["languages"][0]) == [f"l{k}" for k in range(6)] and found["languages"][1] == ["l6"]
    assert max(found["shares"][0]) < 0.25
    few = language_id.learn_languages(spark.createDataFrame(made, "doc_id long, text string, lang string"), most=3)
    assert few.grams.shape[0] == (1 << 15) * 3 // 7 and language_id.infer([draw("l2", 80)], few, 12, 2.0)["lang"][0] == "l2"


def test_slices_and_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["un", "deux", "one", "two", "été", "x1"], n)) for n in (0, 1, 5, 400, 3)] + [None]
    whole = language_id.distinct_words(texts)
    monkeypatch.setattr(language_id, "CHUNK_CHARACTERS", 20)
    cut = language_id.distinct_words(texts)

    def counts(found):
        names, text, word, times = found
        return {(int(t), names[w]): int(n) for t, w, n in zip(text, word, times)}

    assert counts(whole) == counts(cut)
    assert [t for part in language_id.slices(texts) for t in part] == texts
    assert all("".join(language_id.parts_of(t)) == (t or "") for t in texts)


def plain_label_model(votes, start, prior, rounds):
    """How often each voter fires on either kind, by the textbook's loop over documents; voters count as independent."""
    believed, rate = [float(x) for x in start], prior
    for _ in range(rounds):
        on = [[0.1, 0.1] for _ in votes[0]]
        sums = [0.2, 0.2]
        for v, b in zip(votes, believed):
            for kind, share in ((0, b), (1, 1 - b)):
                sums[kind] += share
                for j, x in enumerate(v):
                    on[j][kind] += share * x
        fires = [[o[k] / sums[k] for k in (0, 1)] for o in on]
        believed = []
        for v in votes:
            odds = math.log(rate / (1 - rate))
            for x, (p, q) in zip(v, fires):
                if p > q:
                    odds += math.log(p / q) if x else math.log((1 - p) / (1 - q))
            believed.append(1 / (1 + math.exp(-odds)))
        rate = sum(believed) / len(believed)
    return fires, believed


def test_label_model_is_that_of_plain_em():
    rng = np.random.default_rng(4)
    truth = rng.random(600) < 0.3
    hit, miss = np.array([0.8, 0.7, 0.6, 0.75, 0.65]), np.array([0.1, 0.05, 0.2, 0.15, 0.1])
    votes = (rng.random((600, 5)) < np.where(truth[:, None], hit, miss)).astype(float)
    start = votes.mean(axis=1) > 0.4
    model = toxicity.fit_label_model(votes, start, 0.3, rounds=25)
    fires, _ = plain_label_model(votes.tolist(), start.tolist(), 0.3, 25)
    assert model.fires_toxic == pytest.approx([f[0] for f in fires], abs=2e-3)
    assert model.fires_clean == pytest.approx([f[1] for f in fires], abs=2e-3)
    assert model.fires_toxic == pytest.approx(hit, abs=0.1) and model.fires_clean == pytest.approx(miss, abs=0.06)
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.9


def test_copied_voters_share_their_weight():
    rng = np.random.default_rng(5)
    truth = rng.random(800) < 0.4
    one = (rng.random((800, 3)) < np.where(truth[:, None], 0.75, 0.15)).astype(float)
    copied = np.concatenate([one, one[:, :1], one[:, :1], one[:, :1]], axis=1)
    model = toxicity.fit_label_model(copied, copied.mean(axis=1) > 0.4, 0.4)
    same = model.weight[[0, 3, 4, 5]]
    assert np.ptp(same) < 1e-9 and same.sum() < 1.3 and model.weight[1] > 0.6


def test_preferences_are_those_of_a_plain_logistic_fit():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(0.6, 1, (300, 4)), rng.normal(0, 1, (300, 4))
    found = quality_ranking.fit_preferences(good, bad, 4_000, seed=9, ridge=1e-2, rounds=3_000)
    draw = np.random.default_rng(9)
    gap = good[draw.integers(300, size=4_000)] - bad[draw.integers(300, size=4_000)]
    # Newton's method on the same likelihood of pairs.
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-gap @ w))
        slope = gap.T @ (1 - p) / len(gap) - 1e-2 * w
        curve = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + 1e-2 * np.eye(4)
        w = w + np.linalg.solve(curve, slope)
    assert found == pytest.approx(w, abs=1e-3)


def test_quality_labels_of_one_kind_give_their_share(spark):
    docs = spark.createDataFrame([(i, f"some words {i} here") for i in range(30)], "doc_id long, text string")
    for value in (0, 1):
        labels = spark.createDataFrame([(i, value) for i in range(30)], "doc_id long, quality int")
        found = {(r["score"], r["predicted"]) for r in quality_ranking.score_quality(docs, labels).collect()}
        assert found == {(float(value), value)}
