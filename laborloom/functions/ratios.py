"""Guarded ratios. Spark raises on division by zero, so every ratio goes
through ``nullif``; operands become doubles first so that integer, decimal and
double inputs give the same quotient."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def half_up(value: Column | str, digits: int) -> Column:
    """Round half up on twelve decimals rather than on the binary double.

    Sums of doubles carry order-dependent noise in the last bits; going through
    a decimal first keeps exact ties such as 10.425 from depending on it.
    """
    return F.round(_double(value).cast("decimal(38,12)"), digits).cast("double")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    return _double(top) / F.nullif(_double(bottom), F.lit(0.0))


def rounded_ratio(top: Column | str, bottom: Column | str, digits: int = 2) -> Column:
    """A missing numerator counts as 0, a missing or zero denominator gives NULL."""
    return half_up(ratio(F.coalesce(_double(top), F.lit(0.0)), bottom), digits)


def change_ratio(current: Column | str, previous: Column | str) -> Column:
    """current / previous - 1."""
    return ratio(current, previous) - 1


def pct_over(current: Column, base: Column, digits: int = 2) -> Column:
    """Percent above a base value."""
    return half_up(ratio(_double(current) - _double(base), base) * 100, digits)
