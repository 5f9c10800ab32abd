"""Technical indicators over a ``Staged`` series of bars (o h l c v), fractional differences of the whole past, and lagged-day volatility."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.fold import fold
from barloom.joins import asof_join
from barloom.operators.breaks import sadf_design
from barloom.operators.volatility import _changes, ewm, fixed_width_weights, frac_diff_weights, smoothed
from barloom.ordering import BLOCK_ROWS, DAY_US, HOUR_US, Staged, running
from barloom.scan import linear_scan


def bollinger(s: Staged, close: str = "c", window: int = 20, width: float = 2.0) -> Staged:
    """``band_mid``, ``band_high`` and ``band_low``: the mean and ``width`` population standard deviations around it."""
    s.let(_m=s.roll(F.avg, close, window), _d=s.roll(F.stddev_pop, close, window))
    return s.let(band_mid=F.col("_m"), band_high=F.col("_m") + width * F.col("_d"), band_low=F.col("_m") - width * F.col("_d"))


def money_flow_index(s: Staged, window: int = 14, out: str = "mfi") -> Staged:
    """100 - 100 / (1 + rising flow / falling flow) of the typical price x volume."""
    s.let(_tp=(F.col("h") + F.col("l") + F.col("c")) / 3).let(_pt=s.lag("_tp"), _mf=F.col("_tp") * F.col("v"))
    s.let(_up=F.when(F.col("_tp") > F.col("_pt"), F.col("_mf")).otherwise(0.0), _dn=F.when(F.col("_tp") < F.col("_pt"), F.col("_mf")).otherwise(0.0))
    s.let(_su=s.roll(F.sum, "_up", window), _sd=s.roll(F.sum, "_dn", window))
    return s.let(**{out: F.when(F.col("_sd") == 0, F.when(F.col("_su").isNotNull(), F.lit(100.0))).otherwise(100 - 100 / (1 + F.try_divide("_su", "_sd")))})


def ease_of_movement(s: Staged, window: int = 14) -> Staged:
    """``eom`` and its rolling mean ``eom_mean``: midpoint move x range per 100 million of volume."""
    s.let(_h1=s.lag("h"), _l1=s.lag("l"))
    move = (F.col("h") - F.col("_h1") + F.col("l") - F.col("_l1")) * (F.col("h") - F.col("l"))
    return s.let(eom=F.try_divide(move, 2 * F.col("v")) * 1e8).let(eom_mean=s.roll(F.avg, "eom", window))


def rolling_vwap(s: Staged, window: int = 14, out: str = "vwap") -> Staged:
    s.let(_pv=(F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v"))
    return s.let(**{out: F.try_divide(s.roll(F.sum, "_pv", window), s.roll(F.sum, "v", window))})


def volume_flows(df: DataFrame, keys: Sequence[str], order: str, close: str = "c", volume: str = "v", cell_us: int = DAY_US) -> DataFrame:
    """keys, order, ``obv`` (on-balance volume: + on a rise, - on a fall) and ``vpt`` (volume x relative change, summed)."""
    rows = running(df, keys, order, [], {"_b": ("last", close)}, inclusive=False, cell_us=cell_us)
    move = F.when(F.col(close) > F.col("_b"), F.col(volume)).when(F.col(close) < F.col("_b"), -F.col(volume)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_o": move, "_p": F.coalesce(F.col(volume) * (F.try_divide(F.col(close), F.col("_b")) - 1), F.lit(0.0))})
    return running(rows, keys, order, [], {"obv": ("sum", "_o"), "vpt": ("sum", "_p")}, cell_us=cell_us).select(*keys, order, "obv", "vpt")


def true_strength(df: DataFrame, keys: Sequence[str], order: str, close: str, slow: int = 25, fast: int = 13, cell_us: float = 6 * HOUR_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, order and ``tsi``: twice smoothed change over twice smoothed absolute change, x 100; null in the first row and where there was no change at all."""
    rows = _changes(df, keys, order, close, cell_us)
    d = F.col("_d")
    # The first change starts all four means; what comes before it changes nothing.
    rows = running(rows, keys, "_ts", [], {"_seen": ("count", "_d")}, cell_us=cell_us).withColumn("_first", (F.col("_seen") == 1) & d.isNotNull())
    first = F.col("_first")
    rows = linear_scan(rows, keys, "_ts", {"_p": smoothed(2 / (slow + 1), d, first), "_q": smoothed(2 / (slow + 1), F.abs(d), first)}, cell_us=cell_us, block_rows=block_rows)
    known = lambda c: F.when(d.isNotNull(), F.col(c))
    rows = linear_scan(rows, keys, "_ts", {"_pp": smoothed(2 / (fast + 1), known("_p"), first), "_qq": smoothed(2 / (fast + 1), known("_q"), first)}, cell_us=cell_us, block_rows=block_rows)
    return rows.select(*keys, F.col("_ts").alias(order), F.when(d.isNotNull(), 100 * F.try_divide("_pp", "_qq")).alias("tsi"))


def daily_volatility(prices: DataFrame, keys: Sequence[str], ts: str = "ts", close: str = "close", lookback: float = 100) -> DataFrame:
    """keys, ts and ``volatility``: the exponentially weighted deviation of the return since the last price more than a day before. Times are epoch
    microseconds; prices without such a past are left out."""
    due = prices.select(*keys, ts, close).withColumn("_due", F.col(ts) - F.lit(DAY_US))
    past = prices.select(*keys, F.col(ts).alias("_at"), F.col(close).alias("_past"))
    rows = asof_join(due, past, keys, "_due", "_at", ["_past"], exact=False).where(F.col("_past").isNotNull())
    out = ewm(rows.withColumn("_r", F.try_divide(F.col(close), F.col("_past")) - 1), keys, ts, "_r", span=lookback)
    return out.select(*keys, ts, F.col("ewm_std").alias("volatility"))


class _ExpandingDifference:
    """The dot product of the whole past with the weights, from the row on where the weights left out are below the threshold."""

    def __init__(self, d: float, threshold: float) -> None:
        self.d, self.threshold, self.ts, self.x = d, threshold, [], []

    def feed(self, columns):
        keep = ~np.isnan(columns["_x"].astype(float))
        self.ts.append(columns["_ts"][keep])
        self.x.append(columns["_x"][keep].astype(float))
        return {}

    def finish(self):
        ts, x = np.concatenate(self.ts), np.concatenate(self.x)
        n = len(x)
        if not n:
            return {}
        w = frac_diff_weights(self.d, n)
        loss = np.cumsum(np.abs(w[::-1]))
        skip = int((loss / loss[-1] > self.threshold).sum())
        full = np.fft.irfft(np.fft.rfft(w, 2 * n) * np.fft.rfft(x, 2 * n), 2 * n)[:n]  # every dot product at once
        return {"_ts": ts[skip:], "frac_diff": full[skip:]} if skip < n else {}


def expanding_difference(df: DataFrame, keys: Sequence[str], order: str, value: str, d: float, threshold: float = 0.01) -> DataFrame:
    """keys, order and ``frac_diff`` over the whole past; nulls are passed over. A series is held by its task."""
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(value).cast("double").alias("_x"))
    kind = rows.schema["_ts"].dataType.simpleString()
    return fold(rows, keys, ["_ts"], ["_ts", "_x"], lambda: _ExpandingDifference(d, threshold), f"_ts {kind}, frac_diff double").withColumnRenamed("_ts", order)


def adf_statistic(x: np.ndarray, lags: int = 1) -> float:
    """Augmented Dickey-Fuller t value with a constant."""
    y, z, _ = sadf_design(x, "linear", list(range(1, lags + 1)), True)
    y = np.delete(y, y.shape[1] - 1, axis=1)  # without the trend
    if len(z) <= y.shape[1] + 1:
        return float("nan")
    b, *_ = np.linalg.lstsq(y, z, rcond=None)
    e = z - y @ b
    inv = np.linalg.pinv(y.T @ y)
    s = e @ e / (len(z) - y.shape[1]) * inv[0, 0]
    return float(b[0] / np.sqrt(s)) if s > 0 else float("nan")


class _DifferenceSearch:
    def __init__(self, ds: Sequence[float], threshold: float, lags: int) -> None:
        self.ds, self.threshold, self.lags, self.x = ds, threshold, lags, []

    def feed(self, columns):
        x = columns["_x"].astype(float)
        self.x.append(x[~np.isnan(x)])
        return {}

    def finish(self):
        x = np.concatenate(self.x) if self.x else np.zeros(0)
        out = []
        for d in self.ds:
            w = fixed_width_weights(d, self.threshold)
            if len(x) < len(w) + 10:
                continue
            y = np.convolve(x, w, "valid")
            out.append((d, adf_statistic(y, self.lags), float(np.corrcoef(y, x[len(w) - 1 :])[0, 1]) if y.std() > 0 and x[len(w) - 1 :].std() > 0 else np.nan))
        return {k: np.array([r[i] for r in out]) for i, k in enumerate(("d", "adf", "corr"))} if out else {}


def difference_search(df: DataFrame, keys: Sequence[str], order: str, value: str, ds: Sequence[float] = tuple(i / 10 for i in range(11)), threshold: float = 0.01, lags: int = 1) -> DataFrame:
    """keys, ``d``, ``adf`` (t value of the fixed-width difference) and ``corr`` with the level: the least d whose series is stationary keeps most memory."""
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(value).cast("double").alias("_x"))
    return fold(rows, keys, ["_ts"], ["_x"], lambda: _DifferenceSearch(ds, threshold, lags), "d double, adf double, corr double")
