"""Two-sided p value of Student's t as a Catalyst expression.

With x = df / (df + t^2) the tail probability is the regularized incomplete beta
function I_x(df/2, 1/2), read off its continued fraction. The fraction runs in
its fast region: for small t that of 1 - I_(1-x)(1/2, df/2). Lentz's recurrence
needs at most some 100 of its steps for degrees up to 1e6.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 120
SHIFT = 16


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not in every step that names it."""
    return F.transform(F.array(value), body)[0]


def _log_gamma_step(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)): the asymptotic series at a + SHIFT, led back to a by factors.

    A difference of two log gammas would lose its digits for large a.
    """
    back = F.aggregate(
        F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda total, k: total + F.log((a + k) / (a + k + 0.5))
    )
    z = a + SHIFT
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    return back + series


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of I_x(a, b), without its leading factor."""
    # g = 1 + d1 / (1 + d2 / (1 + ...)); c and d are the ratios of successive numerators and denominators.
    begin = F.struct(*[F.lit(v).alias(name) for name, v in (("c", 1.0), ("d", 0.0), ("g", 1.0))])

    def step(state: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(k % 2 == 0, even).otherwise(odd) * x
        moved = F.struct((1 + term / state["c"]).alias("c"), (1 / (1 + term * state["d"])).alias("d"))
        return _let(moved, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (state["g"] * n["c"] * n["d"]).alias("g")))

    return 1 / F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step)["g"]


def two_sided_p(t: Column, df: Column) -> Column:
    def tail(v: Column) -> Column:
        a, square, df = v["df"] / 2, v["t"] * v["t"], v["df"]
        x, y = df / (df + square), square / (df + square)
        front = F.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) - a * F.log1p(square / df) + F.log(y) / 2)
        half = F.lit(0.5)
        direct = x < (a + 1) / (a + 2.5)
        # One fraction, with the sides swapped where the other one is fast.
        sides = F.struct(
            F.when(direct, a).otherwise(half).alias("a"),
            F.when(direct, half).otherwise(a).alias("b"),
            F.when(direct, x).otherwise(y).alias("x"),
            front.alias("front"),
            direct.alias("direct"),
        )

        def value(s: Column) -> Column:
            return _let(
                s["front"] * _fraction(s["a"], s["b"], s["x"]) / s["a"], lambda area: F.when(s["direct"], area).otherwise(1 - area)
            )

        # A square too small to divide by is no difference at all.
        return F.when(y == 0, F.lit(1.0)).otherwise(_let(sides, value))

    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("df")), tail)))
    # greatest and least skip NULLs, so an undefined statistic is ruled out first.
    return F.when(t.isNotNull() & df.isNotNull(), p)
