"""Volatility and trend features over a ``Staged`` series of bars (o h l c v), and exponentially weighted ones as linear recurrences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.ordering import BLOCK_ROWS, HOUR_US, Staged, running
from barloom.scan import linear_scan


def _ln(a: str, b: str):
    return F.ln(F.try_divide(a, b))


def parkinson(s: Staged, window: int = 20, out: str = "parkinson") -> Staged:
    s.let(_hl2=F.pow(_ln("h", "l"), 2) / (4 * math.log(2)))
    return s.let(**{out: F.sqrt(s.roll(F.avg, "_hl2", window))})


def garman_klass(s: Staged, window: int = 21, out: str = "garman_klass") -> Staged:
    s.let(_a=F.pow(_ln("h", "l"), 2), _b=F.pow(_ln("c", "o"), 2))
    x = 0.5 * s.roll(F.avg, "_a", window) - (2 * math.log(2) - 1) * s.roll(F.avg, "_b", window)
    return s.let(_gk=x).let(**{out: F.when(F.col("_gk") >= 0, F.sqrt("_gk"))})


def rogers_satchell(s: Staged, window: int = 21, out: str = "rogers_satchell") -> Staged:
    s.let(_a=_ln("h", "c") * _ln("h", "o"), _b=_ln("l", "c") * _ln("l", "o"))
    return s.let(_rs=s.roll(F.avg, "_a", window) + s.roll(F.avg, "_b", window)).let(**{out: F.when(F.col("_rs") >= 0, F.sqrt("_rs"))})


def yang_zhang(s: Staged, window: int = 21, out: str = "yang_zhang") -> Staged:
    """Overnight, open-to-close and range parts; the first two are centred on their rolling means."""
    rogers_satchell(s, window, "_rsv")
    s.let(_pc=s.lag("c")).let(_on=_ln("o", "_pc"), _oc=_ln("c", "o"))
    s.let(_on2=F.pow(F.col("_on") - s.roll(F.avg, "_on", window), 2), _oc2=F.pow(F.col("_oc") - s.roll(F.avg, "_oc", window), 2))
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    return s.let(**{out: F.sqrt(s.roll(F.avg, "_on2", window) + k * s.roll(F.avg, "_oc2", window) + (1 - k) * F.pow(F.col("_rsv"), 2))})


def intrinsic_entropy(s: Staged, total_volume: str, window: int = 21, out: str = "intrinsic_entropy") -> Staged:
    """Volume-weighted entropy of overnight, open-to-close and range moves; ``total_volume`` is the market's."""
    s.let(_pc=s.lag("c"), _p=F.try_divide(F.col("v"), F.col(total_volume)), _pv=s.lag("v"))
    s.let(_q=F.try_divide(F.col("_pv"), F.col(total_volume)))
    s.let(
        _co=-_ln("o", "_pc") * F.col("_p") * F.ln("_q"), _oc=-_ln("c", "o") * F.col("_p") * F.ln("_p"),
        _oh=-(_ln("o", "h") * _ln("h", "c") + _ln("l", "o") * _ln("l", "c")) * F.col("_p") * F.ln("_p"),
    )
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    return s.let(**{out: F.abs(s.roll(F.avg, "_co", window) + k * s.roll(F.avg, "_oc", window) + (1 - k) * s.roll(F.avg, "_oh", window))})


def true_range(s: Staged, out: str = "true_range") -> Staged:
    s.let(_pc=s.lag("c"))
    return s.let(**{out: F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("_pc")), F.abs(F.col("l") - F.col("_pc")))})


def rolling_moments(s: Staged, value: str, window: int, prefix: str = "roll") -> Staged:
    """Rolling mean, sample standard deviation, and bias-corrected skewness and excess kurtosis, from centred power sums."""
    frame = s.w.rowsBetween(1 - window, 0)
    s.let(_full=F.count(value).over(frame) == window, _skew=F.skewness(value).over(frame), _kurt=F.kurtosis(value).over(frame))
    n = float(window)
    skew = F.col("_skew") * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("_kurt") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return s.let(**{
        f"{prefix}_mean": s.roll(F.avg, value, window), f"{prefix}_std": s.roll(F.stddev_samp, value, window),
        f"{prefix}_skew": F.when(F.col("_full"), skew), f"{prefix}_kurt": F.when(F.col("_full"), kurt),
    })


def frac_diff_weights(d: float, size: int) -> np.ndarray:
    """Weights of the fractional difference, lag 0 first."""
    k = np.arange(1, size)
    return np.cumprod(np.concatenate([[1.0], -(d - k + 1) / k]))


def fixed_width_weights(d: float, threshold: float, most: int = 1 << 22) -> np.ndarray:
    """The weights before the first one smaller than the threshold, lag 0 first. More than ``most`` are refused, not cut."""
    size = 1024
    while True:
        w = frac_diff_weights(d, size)
        small = np.flatnonzero(np.abs(w) < threshold)
        if len(small):
            return w[: small[0]]
        if size >= most:
            raise ValueError(f"more than {most} weights are above the threshold")
        size *= 4


def fixed_width_difference(s: Staged, value: str, d: float, threshold: float = 1e-5, out: str = "frac_diff") -> Staged:
    """Fractional difference over the fixed width of the weights above the threshold. A width beyond the series' halo is refused."""
    w = fixed_width_weights(d, threshold)
    terms = [F.lit(float(x)) * (s.lag(value, k) if k else F.col(value)) for k, x in enumerate(w)]
    return s.let(**{out: sum(terms[1:], terms[0])})


def ewm(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float | None = None, span: float | None = None, adjust: bool = True, least: int = 1, cell_us: float = 6 * HOUR_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, order, ``ewm_mean`` and ``ewm_std`` (bias-corrected) of each series; order is unique in a series. ``adjust`` weighs by the sum of weights; a null or NaN value only lets
    the weights decay; both are null until ``least`` values have come, the deviation until two have. Sums run as linear recurrences over blocks
    (barloom.scan), about the series' mean, so that squares keep their digits."""
    a = alpha if alpha is not None else 2 / (span + 1)
    q = 1 - a
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(value).cast("double").alias("_x")).withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    middle = rows.groupBy(*keys).agg(F.coalesce(F.avg("_x"), F.lit(0.0)).alias("_c"))
    l, r = rows.alias("l"), middle.alias("r")
    rows = l.join(r, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select("l.*", "r._c")
    ok, x = F.col("_x").isNotNull(), F.coalesce(F.col("_x") - F.col("_c"), F.lit(0.0))
    one = F.when(ok, 1.0).otherwise(0.0)
    if adjust:
        b = {"_w": (F.lit(q), one), "_s": (F.lit(q), x), "_ss": (F.lit(q), x * x), "_w2": (F.lit(q * q), one)}
    else:
        rows = running(rows, keys, "_ts", [], {"_i": ("count", F.lit(1))}, cell_us=cell_us)
        rows = running(rows, keys, "_ts", [], {"_j": ("last", F.when(ok, F.col("_i")))}, inclusive=False, cell_us=cell_us)
        first, decay = F.col("_j").isNull(), F.pow(F.lit(q), (F.col("_i") - F.col("_j")).cast("double"))
        keep = F.when(~ok, 1.0).when(first, 0.0).otherwise(decay / (decay + a))
        new = F.when(~ok, 0.0).when(first, 1.0).otherwise(F.lit(a) / (decay + a))
        b = {"_w": (keep, new), "_s": (keep, new * x), "_ss": (keep, new * x * x), "_w2": (keep * keep, new * new)}
    out = linear_scan(rows, keys, "_ts", b | {"_n": (F.lit(1.0), one)}, cell_us=cell_us, block_rows=block_rows)
    w, n = F.col("_w"), F.col("_n")
    mean = F.try_divide(F.col("_s"), w)
    spread = w * w - F.col("_w2")
    deviation = F.sqrt(F.greatest(F.col("_ss") / w - mean * mean, F.lit(0.0)) * w * w / spread)
    there = n >= max(least, 1)
    return out.select(*keys, F.col("_ts").alias(order), F.when(there, mean + F.col("_c")).alias("ewm_mean"), F.when(there & (n > 1) & (spread > 0), deviation).alias("ewm_std"))


def _changes(df: DataFrame, keys: Sequence[str], order: str, close: str, cell_us: float) -> DataFrame:
    """keys, ``_ts``, ``_x`` and ``_d``, the change since the row before."""
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(close).cast("double").alias("_x"))
    rows = running(rows, keys, "_ts", [], {"_b": ("last", "_x"), "_i": ("count", F.lit(1))}, inclusive=False, cell_us=cell_us)
    return rows.withColumn("_d", F.col("_x") - F.col("_b"))


def smoothed(alpha: float, x: Column, first: Column) -> tuple[Column, Column]:
    """The recurrence of an exponential mean that starts at its first value, for ``linear_scan``; a null leaves it as it is."""
    known = x.isNotNull()
    return F.when(first, 0.0).when(known, 1 - alpha).otherwise(1.0), F.when(~known, 0.0).when(first, x).otherwise(alpha * x)


def rsi(df: DataFrame, keys: Sequence[str], order: str, close: str, window: int = 14, fill: float | None = None, cell_us: float = 6 * HOUR_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, order and ``rsi``: Wilder's relative strength index; null (or ``fill``) until the window has come. The first row counts as no change, and so does a
    change that isn't known."""
    rows = _changes(df, keys, order, close, cell_us)
    first, d = F.coalesce(F.col("_i"), F.lit(0)) == 0, F.coalesce(F.col("_d"), F.lit(0.0))
    out = linear_scan(rows, keys, "_ts", {"_up": smoothed(1 / window, F.greatest(d, F.lit(0.0)), first), "_down": smoothed(1 / window, F.greatest(-d, F.lit(0.0)), first)}, cell_us=cell_us, block_rows=block_rows)
    value = F.when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_up", "_down")))
    there = F.coalesce(F.col("_i"), F.lit(0)) + 1 >= window
    out = out.select(*keys, F.col("_ts").alias(order), F.when(there, value).alias("rsi"))
    return out.na.fill(fill, ["rsi"]) if fill is not None else out
