"""p values against closed forms at 1, 2 and 4 degrees, the normal limit, and symmetry."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from laborloom.functions.student_t import two_sided_p

TS = [1e-9, 1e-3, 0.1, 0.5, 1.0, 1.7, 2.0, 3.0, 5.0, 12.7062, 60.0, 1e4]


def _values(spark, pairs):
    rows = spark.createDataFrame(pairs, "t double, df double").select("t", "df", two_sided_p(F.col("t"), F.col("df")).alias("p"))
    return {(r["t"], r["df"]): r["p"] for r in rows.collect()}


def test_closed_forms(spark):
    found = _values(spark, [(t, df) for t in TS for df in (1.0, 2.0, 4.0)])
    for t in TS:
        assert found[t, 1.0] == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-10)
        assert found[t, 2.0] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-10)
        assert found[t, 4.0] == pytest.approx(1 - t * (6 + t * t) / (4 + t * t) ** 1.5, abs=1e-10)


def test_normal_limit(spark):
    """At very many degrees t is normal, but for (t^3 + t) / (4 df) times the density, the next term of the limit."""
    for df in (1e5, 1e6):
        found = _values(spark, [(t, df) for t in TS[:9]])
        for (t, _), p in found.items():
            density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            limit = math.erfc(t / math.sqrt(2)) + 2 * density * (t**3 + t) / (4 * df)
            assert p == pytest.approx(limit, abs=40 / df**2 + 1e-10)


def test_signs_zero_and_missing(spark):
    found = _values(spark, [(-2.0, 7.0), (2.0, 7.0), (0.0, 7.0), (1e-200, 7.0), (None, 7.0), (2.0, None)])
    assert found[-2.0, 7.0] == found[2.0, 7.0] == pytest.approx(0.0856, abs=1e-4)
    assert found[0.0, 7.0] == found[1e-200, 7.0] == 1.0
    assert found[None, 7.0] is None and found[2.0, None] is None


def test_between_whole_degrees_p_falls(spark):
    dfs = [0.5 + k / 4 for k in range(160)]
    found = _values(spark, [(2.0, df) for df in dfs])
    values = [found[2.0, df] for df in dfs]
    assert all(a > b > 0 for a, b in zip(values, values[1:]))


def test_steps_are_few(spark):
    plan = spark.createDataFrame([(1.0, 2.0)], "t double, df double").select(two_sided_p(F.col("t"), F.col("df")).alias("p"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("sequence(") <= 2
