"""Numeric expressions that Catalyst has no direct name for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b with IEEE results for a zero divisor: infinities, and NaN for 0 / 0."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, a / b).when(a > 0, inf).when(a < 0, -inf).when(a == 0, nan)


def divide(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def r6(x: Column) -> Column:
    """Rounded for comparison; without negative zeros."""
    return F.round(x, 6) + F.lit(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tile(x: Column, size: int) -> Column:
    return F.floor(x / F.lit(size)).cast("int")
