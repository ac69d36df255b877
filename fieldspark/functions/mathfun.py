"""Transforms, weights and kernels as Column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column, shift: float = 0.0) -> Column:
    """log(1 + exp(x)) + shift, stable for large |x|."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)) + shift


def inverse_softplus(y: Column, shift: float = 0.0) -> Column:
    """Minus infinity at or below the shift; the identity where softplus is."""
    z = y - shift
    return F.when(z <= 0, F.lit(float("-inf"))).when(z > 30, z).otherwise(F.log(F.expm1(z)))


def sigmoid(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    e = F.exp(-F.abs(x))
    return low + (high - low) * F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def inverse_sigmoid(y: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Infinite at and beyond the ends."""
    p = (y - low) / (high - low)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(F.log(p / (1 - p)))


def gaussian(x: Column, centre: Column, scale: Column | float) -> Column:
    """Normal density without its constant, which cancels in a weighted mean."""
    return F.exp(-0.5 * F.pow((x - centre) / scale, 2))


def matern32(distance: Column, variance: float = 1.0) -> Column:
    """Kernel of a distance that is already divided by the lengthscales."""
    r = distance * 3**0.5
    return variance * (1 + r) * F.exp(-r)


def known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)
