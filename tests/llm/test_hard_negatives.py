"""Hard negatives against all scores, with awkward rows; bounds hold; the SQL form agrees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog.compare import compare
from laborloom.llm import hard_negatives, queries
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, x string"


def plain(rows, every, label_of, k=5, m=3):
    kept = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label_of(vec_id, label), [math.floor(256 * float(np.float32(x))) for x in v])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, other) for b, (other, w) in kept.items() if b != a)
        for s, b, other in [r for r in scores if r[2] == label][:k]:
            hard = [(-t, c) for t, c, o in scores if o != label and 50 * -s <= 100 * -t <= 95 * -s][:m]
            out |= {(a, b, rank, c, -s, t) for rank, (t, c) in enumerate(hard, 1)}
    return out


def rows_of(result):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = [tuple(r[n] for n in names) for r in result.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    made = []
    for i in range(300):
        v = rng.normal(size=64) + (i % 3)
        made.append((i, [float(x) for x in v], int(rng.integers(0, 4)), "s", "r", "x"))
    same = made[10][1]
    made += [(300 + i, same, i % 2, "", "", "") for i in range(150)]  # many equal vectors: ties
    made += [made[5], (5, made[6][1], 1, "", "", "")]  # a repeated row, another row of its id
    made += [(None, same, 1, "", "", ""), (461, None, 1, "", "", ""), (462, same, None, "", "", "")]
    made += [(463, [None] * 64, 1, "", "", ""), (464, [float("nan")] * 64, 1, "", "", ""), (465, [float("inf")] * 64, 1, "", "", "")]
    made += [(466, [], 1, "", "", ""), (470, [1.0, 2.0], 1, "", "", ""), (467, [0.0] * 64, 1, "", "", ""), (468, [3.0] * 100, 0, "", "", "")]
    return made


@pytest.mark.parametrize(("block_rows", "anchor_rows"), [(4096, 2048), (37, 5)])
def test_matches_all_scores(spark, rows, block_rows, anchor_rows):
    table = spark.createDataFrame(rows, SCHEMA)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    got = hard_negatives.mine_negatives(
        table, F.col("vec_id") % 10 == 0, shifted, block_rows=block_rows, anchor_rows=anchor_rows
    )
    want = plain(rows, 10, lambda i, label: (label + 1) % 4 if i % 7 == 0 else label)
    assert want and rows_of(got) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    made = [(i, [float(x) for x in rng.normal(size=8) * 2e5], i % 2, "", "", "") for i in range(80)]
    got = hard_negatives.mine_negatives(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 4 == 0)
    assert rows_of(got) == plain(made, 4, lambda i, label: label)


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(50, 64)).cumsum(axis=1))).astype(np.int64)
    table = pa.table({"vec_id": np.arange(50), "label": np.zeros(50, int), "x": list(x), "summary": list(hard_negatives.summaries(x))})
    block = hard_negatives.Block(table)
    exact, widths = (x @ x.T).astype(float), []
    for mean, deviation in block.levels:
        middle, reach = mean @ mean.T, deviation @ deviation.T
        assert (middle - reach <= exact + 1e-3).all() and (exact <= middle + reach + 1e-3).all()
        widths.append(reach.mean())
    assert widths[0] > widths[1] > widths[2]


def test_empty_table(spark):
    assert hard_negatives.mine_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0


def test_query_matches_its_sql(spark, duck):
    name = "op11_hard_negatives"
    assert compare(spark, duck, SF_DIR, queries.QUERIES[name], queries.SQL[name]).startswith("ok")
