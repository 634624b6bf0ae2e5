"""Normal and Student-t quantiles without scipy, as numbers and as column expressions."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From so many sampled rows on, the normal quantile stands in for Student's t.
LARGE = 30


def z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _tail(t: float, df: int) -> float:
    """P(T > t) for t >= 0 by the finite sums that exist for whole degrees of freedom."""
    theta = math.atan2(t, math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        term, total = c, 0.0
        for k in range(3, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        inside = 2 / math.pi * (theta + s * total)
    else:
        term, total = 1.0, 0.0
        for k in range(2, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        inside = s * total
    return (1 - inside) / 2


@lru_cache(maxsize=4096)
def t(p: float, df: int) -> float:
    """The quantile p > 1/2 of Student's t with df degrees of freedom."""
    low, high = 0.0, 1.0
    while _tail(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def factor(count: Column, confidence: float) -> Column:
    """The factor of a standard error for a confidence interval over `count` sampled rows."""
    p = 0.5 + confidence / 2
    small = F.array(*[F.lit(t(p, df)) for df in range(1, LARGE - 1)])
    at = F.least(F.greatest(count - 1, F.lit(1)), F.lit(LARGE - 2)).cast("int")
    return F.when(count >= LARGE, F.lit(z(p))).otherwise(F.element_at(small, at))


def factor_sql(count: str, confidence: float) -> str:
    """The same as SQL text."""
    p = 0.5 + confidence / 2
    small = ", ".join(repr(t(p, df)) for df in range(1, LARGE - 1))
    return f"CASE WHEN {count} >= {LARGE} THEN {z(p)!r} ELSE ([{small}])[CAST(least(greatest({count} - 1, 1), {LARGE - 2}) AS INTEGER)] END"
