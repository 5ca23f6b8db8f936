"""The chi-square distribution, from the regularised incomplete gamma function."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function P(a, x)."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    # continued fraction of the upper function
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return max(0.0, 1.0 - scale * h)


def cdf(x: float, k: float) -> float:
    return gamma_p(k / 2, x / 2)


def survival(x: float, k: float) -> float:
    return 1.0 - cdf(x, k)


def quantile(p: float, k: float) -> float:
    """The x at which the distribution with ``k`` degrees of freedom reaches ``p``."""
    low, high = 0.0, max(1.0, k)
    while cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def survival_of(x: Column, dof: int) -> Column:
    """``survival`` of a column of statistics, in Arrow batches; null where it is null."""

    @F.arrow_udf("double")
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else survival(v, dof) for v in values.to_pylist()], pa.float64())

    return apply(x)
