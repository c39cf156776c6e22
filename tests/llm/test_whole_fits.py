"""Models and searches that rest on every row, not on a sample's luck."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborloom.llm import quality_ranking, vector_search


def far_groups(seed: int = 5) -> list[tuple[int, list[float]]]:
    """Groups so far apart that the neighbours of each centroid lie in its own group."""
    rng = np.random.default_rng(seed)
    places = rng.standard_normal((40, 8)) * 100
    return [(i, (places[i // 75] + rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(3000)]


def test_every_group_of_lists_is_reached(spark):
    vectors = far_groups()
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = {}
    for r in vector_search.nearest_vectors(table, F.col("vec_id") % 100 == 0, list_rows=5, degree=4).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    wanted = nearest(vectors)
    assert np.mean([len(found[q] & {*wanted[q]}) / 10 for q in wanted]) >= 0.9


def nearest(vectors):
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        out[q] = np.argsort(d, kind="stable")[:10].tolist()
    return out


@pytest.mark.parametrize(("goods", "bads"), [(40, 7), (5, 33), (9, 9)])
def test_every_labelled_document_is_in_a_pair(spark, goods, bads):
    rows = [(i, [float(i), 0.0], i < goods) for i in range(goods + bads)]
    labelled = spark.createDataFrame(rows, "doc_id long, x array<double>, good boolean")
    pairs = quality_ranking.preference_pairs(labelled, "doc_id", goods, bads, 60, 3).collect()
    assert {p["better"][0] for p in pairs} == {*range(goods)}
    assert {p["worse"][0] for p in pairs} == {*range(goods, goods + bads)} and len(pairs) >= 60


def test_weights_and_cut_over_all_rows_are_those_of_plain_fits(spark):
    rng = np.random.default_rng(8)
    better, worse = rng.normal(0.6, 1, (400, 2)), rng.normal(0, 1, (400, 2))
    knots = np.array([[-4.0, 0.0, 4.0], [-4.0, 1.0, 4.0]])
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(better, worse)], "better array<double>, worse array<double>")
    gap, w = quality_ranking.bent(better, knots) - quality_ranking.bent(worse, knots), np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-gap @ w))
        w = w + np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / 400 + 1e-2 * np.eye(4), gap.T @ (1 - p) / 400 - 1e-2 * w)
    assert quality_ranking.preference_weights(pairs.repartition(3), knots, ridge=1e-2) == pytest.approx(w, abs=1e-4)

    worth = [round(float(x), 1) for x in rng.normal(0, 1, 300)]
    good = [bool(x + e > 0.3) for x, e in zip(worth, rng.normal(0, 0.5, 300))]
    table = spark.createDataFrame(list(zip(worth, good)), "worth double, good boolean")
    levels = sorted({*worth})
    right = [sum(g == (x > level) for x, g in zip(worth, good)) for level in levels]
    at = int(np.argmax(right))
    for rows in (300, 100_000):  # one range, eleven ranges
        assert quality_ranking.best_cut(table, sum(good), rows) == pytest.approx((levels[at] + levels[at + 1]) / 2)
