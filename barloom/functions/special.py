"""The normal distribution and scalar helpers, as Columns and as floats."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution function in double precision.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
EULER_GAMMA = 0.5772156649015328606


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 1e-15; null for null."""
    a = F.abs(x)
    e = F.exp(-(a * a) / 2)
    near = e * reduce(lambda s, c: s * a + F.lit(c), HART_TOP[1:], F.lit(HART_TOP[0])) / reduce(lambda s, c: s * a + F.lit(c), HART_BOTTOM[1:], F.lit(HART_BOTTOM[0]))
    far = e / ((a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + F.lit(0.65)))))) * F.lit(2.506628274631))
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, F.lit(1.0) - tail).when(x.isNotNull(), tail)


def norm_cdf_sql(x: str) -> str:
    """The same in SQL."""
    a = f"abs({x})"
    top = reduce(lambda s, c: f"({s} * {a} + {c!r})", HART_TOP[1:], repr(HART_TOP[0]))
    bottom = reduce(lambda s, c: f"({s} * {a} + {c!r})", HART_BOTTOM[1:], repr(HART_BOTTOM[0]))
    far = f"exp(-{a} * {a} / 2) / (({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) * 2.506628274631)"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {top} / {bottom} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {tail} WHEN {x} IS NOT NULL THEN {tail} END)"


def phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def phi_inverse(p: float) -> float:
    """The standard normal quantile, by bisection and Newton steps on ``phi``."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if phi(mid) < p else (lo, mid)
    x = (lo + hi) / 2
    for _ in range(3):
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        if density > 0:
            x -= (phi(x) - p) / density
    return x


def phi_array(x: np.ndarray) -> np.ndarray:
    return np.array([phi(v) for v in np.asarray(x, dtype=float).ravel()]).reshape(np.shape(x))


def sign(x: Column) -> Column:
    """-1, 0 or 1 as a double, never -0."""
    return F.when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).when(x.isNotNull(), F.lit(0.0))
