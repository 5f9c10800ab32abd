"""Event filters and signals: CUSUM, z-scores, futures rolls, the ETF trick, candle labels, moving-average strategies, Kalman."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.fold import fold
from barloom.ordering import Staged, running


class CusumMachine:
    """Symmetric CUSUM filter: emits a time when the upward or downward sum of changes passes the threshold; that side restarts."""

    def __init__(self, threshold: float) -> None:
        self.t, self.up, self.down, self.last = threshold, 0.0, 0.0, np.nan

    def feed(self, columns):
        hits = []
        for ts, x in zip(columns["_ts"].tolist(), columns["_x"].tolist()):
            d, self.last = x - self.last, x
            if d != d:
                continue
            self.up, self.down = max(0.0, self.up + d), min(0.0, self.down + d)
            if self.down < -self.t:
                self.down = 0.0
                hits.append((ts, -1))
            elif self.up > self.t:
                self.up = 0.0
                hits.append((ts, 1))
        return {"_ts": np.array([h[0] for h in hits]), "direction": np.array([h[1] for h in hits])} if hits else {}

    def finish(self):
        return {}


def cusum_events(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float) -> DataFrame:
    """keys, order and ``direction`` (1 up, -1 down) of each event."""
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(value).cast("double").alias("_x"))
    kind = rows.schema["_ts"].dataType.simpleString()
    return fold(rows, keys, ["_ts"], ["_ts", "_x"], lambda: CusumMachine(threshold), f"_ts {kind}, direction int").withColumnRenamed("_ts", order)


def z_score_events(s: Staged, value: str, mean_window: int, std_window: int, z: float = 3.0, out: str = "event") -> Staged:
    """Whether the value reaches its rolling mean plus z rolling standard deviations."""
    return s.let(**{out: F.coalesce(F.col(value) >= s.roll(F.avg, value, mean_window) + z * s.roll(F.stddev_samp, value, std_window), F.lit(False))})


class DynamicZMachine:
    """Smoothed z-score: a value further than threshold standard deviations from the mean of the last ``lag`` filtered values is a signal
    and enters the filter with weight ``influence``."""

    def __init__(self, lag: int, threshold: float, influence: float) -> None:
        self.lag, self.threshold, self.influence = lag, threshold, influence
        self.filtered: list[float] = []
        self.mean = self.std = np.nan
        self.seen = 0

    def signal(self, x: float) -> int:
        i, out = self.seen, 0
        self.seen += 1
        if i < self.lag:
            self.filtered.append(x)
            return 0
        recent = self.filtered[-self.lag :]
        if i == self.lag:
            self.mean, self.std = float(np.mean(recent)), float(np.std(recent))
            self.filtered = [*recent, x]
            return 0
        if abs(x - self.mean) > self.threshold * self.std:
            out = 1 if x > self.mean else -1
            x = self.influence * x + (1 - self.influence) * self.filtered[-1]
        self.mean, self.std = float(np.mean(recent)), float(np.std(recent))
        self.filtered = [*recent, x]
        return out

    def feed(self, columns):
        return {"_ts": columns["_ts"], "signal": np.array([self.signal(float(x)) for x in columns["_x"]])}

    def finish(self):
        return {}


def dynamic_z_score(df: DataFrame, keys: Sequence[str], order: str, value: str, lag: int, threshold: float, influence: float) -> DataFrame:
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(value).cast("double").alias("_x"))
    kind = rows.schema["_ts"].dataType.simpleString()
    return fold(rows, keys, ["_ts"], ["_ts", "_x"], lambda: DynamicZMachine(lag, threshold, influence), f"_ts {kind}, signal int").withColumnRenamed("_ts", order)


def futures_roll_gaps(df: DataFrame, keys: Sequence[str], ts: str, open_: str = "open", close: str = "close", security: str = "security", current: str = "current_security", backward: bool = False) -> DataFrame:
    """keys, ts and ``gap``: the cumulated open - close at the first row of each new current security (rows whose security is the
    current one count); ``backward`` subtracts the final sum."""
    rows = df.where(F.col(security) == F.col(current))
    rows = running(rows, keys, ts, [], {"_before": ("last", F.col(security)), "_rows": ("count", F.lit(1))}, inclusive=False)
    roll = F.col("_before").isNotNull() & (F.col("_before") != F.col(security))
    rows = rows.withColumn("_gap", F.when(roll, F.col(open_) - F.col(close)).otherwise(F.lit(0.0)))
    rows = running(rows, keys, ts, [], {"gap": ("sum", "_gap")})
    if backward:
        last = rows.groupBy(*keys).agg(F.sum("_gap").alias("_all"))
        rows = rows.join(last, list(keys)).withColumn("gap", F.col("gap") - F.col("_all"))
    return rows.select(*keys, ts, "gap")


class EtfMachine:
    """The worth of 1 invested in a changing allocation. Holdings are set at the first moment, and again at the moment after each change of
    the allocation, at the next open; a moment after a change earns close - open, another the change of close, and both the costs."""

    def __init__(self) -> None:
        self.k, self.h, self.weights, self.changed, self.close = 1.0, None, None, False, None

    def feed(self, columns):
        c = {k: np.stack(columns[k]).astype(float) for k in ("open", "close", "alloc", "cost", "rate", "next_open")}
        values = []
        for i in range(len(columns["_ts"])):
            w = c["alloc"][i]
            at_open = c["next_open"][i] * c["rate"][i]
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.where(at_open != 0, w / np.nansum(np.abs(w)) / at_open, np.nan)
            if self.h is None:
                self.h, self.weights = unit * self.k, np.full(len(w), np.nan)
            else:
                move = c["close"][i] - (c["open"][i] if self.changed else self.close)
                if self.changed:
                    self.h = unit * self.k
                self.k += float(np.nansum(self.h * c["rate"][i] * (move + c["cost"][i])))
                held = np.nan_to_num(w)
                self.changed, self.weights = not np.array_equal(held, self.weights), held
            self.close = c["close"][i]
            values.append(self.k)
        return {"_ts": columns["_ts"], "value": np.array(values)}

    def finish(self):
        return {}


def _member(name: str):
    return lambda x: F.coalesce(F.try_element_at(F.col("_m"), x)[name], F.lit(float("nan")))


def etf_trick(panel: DataFrame, basket: str, ts: str = "ts", security: str = "security") -> DataFrame:
    """basket, ts and ``value`` of each basket's series. ``panel`` has (basket, ts, security) with open, close, alloc, cost and rate; a security
    missing at a moment counts as missing in all. The securities of one moment form a row (its length is the basket's width), and the
    recursion runs over moments."""
    names = ["open", "close", "alloc", "cost", "rate"]
    entry = F.struct(F.col(security), F.struct(*[F.col(n).cast("double").alias(n) for n in names]))
    rows = panel.groupBy(basket, F.col(ts).alias("_ts")).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    members = panel.groupBy(basket).agg(F.sort_array(F.collect_set(security)).alias("_members"))
    nan = F.lit(float("nan"))
    rows = rows.join(members, basket)
    rows = rows.select(basket, "_ts", *[F.transform("_members", _member(n)).alias(n) for n in names])
    following = F.lead("open").over(Window.partitionBy(basket).orderBy("_ts"))
    rows = rows.withColumn("next_open", F.coalesce(following, F.transform("open", lambda _: nan)))
    kind = rows.schema["_ts"].dataType.simpleString()
    out = fold(rows, [basket], ["_ts"], ["_ts", *names, "next_open"], EtfMachine, f"_ts {kind}, value double")
    return out.withColumnRenamed("_ts", ts)


def candle_targets(s: Staged) -> Staged:
    """Demark targets: the base price follows the previous candle's colour; ``low_target`` and ``high_target`` are twice the base less the previous
    high or low, and ``label`` is 1 or -1 when the day breaks one of them."""
    s.let(_o1=s.lag("o"), _h1=s.lag("h"), _l1=s.lag("l"), _c1=s.lag("c"))
    o, h, l, c = (F.col(f"_{x}1") for x in "ohlc")
    base = F.when(c < o, (h + l * 2 + c) / 2).when(c > o, (h * 2 + l + c) / 2).when(c == o, (h + l + c * 2) / 2)
    s.let(base=base).let(low_target=F.col("base") - h, high_target=F.col("base") - l)
    label = F.when(F.col("h") > F.col("high_target"), 1).when(F.col("l") < F.col("low_target"), -1).when(F.col("base").isNotNull(), 0)
    return s.let(label=label)


def pressure(s: Staged) -> Staged:
    """``bull`` (high - open) / open and ``bear`` (open - low) / open."""
    return s.let(bull=F.try_divide(F.col("h") - F.col("o"), F.col("o")), bear=F.try_divide(F.col("o") - F.col("l"), F.col("o")))


def crossover_strategy(s: Staged, close: str = "c", fast: int = 5, slow: int = 20, vol_window: int = 22, target_vol: float = 0.1, most: float = 2.0, cost_bps: float = 10.0, periods: int = 252) -> Staged:
    """Moving-average cross sized to a volatility target, with costs: ``signal``, ``scale``, ``turnover``, ``cost`` and ``net_return``."""
    s.let(_r=F.try_divide(F.col(close), s.lag(close)) - 1, _f=s.roll(F.avg, close, fast), _s=s.roll(F.avg, close, slow))
    s.let(signal=F.when(F.col("_f") > F.col("_s"), 1.0).when(F.col("_f") <= F.col("_s"), -1.0), _vol=s.roll(F.stddev_samp, "_r", vol_window))
    s.let(scale=F.greatest(F.least(F.try_divide(F.lit(target_vol), F.col("_vol") * periods**0.5), F.lit(most)), F.lit(0.0)))
    s.let(_size=F.col("signal") * F.col("scale")).let(_held=s.lag("_size"))
    s.let(turnover=F.abs(F.col("_size") - F.col("_held"))).let(cost=F.col("turnover") * cost_bps / 1e4)
    return s.let(net_return=F.col("_held") * F.col("_r") - F.col("cost"))


def kalman_matrices(q: float, dt: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Transition and white-noise process covariance of a constant-velocity model."""
    return np.array([[1.0, dt], [0.0, 1.0]]), q * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])


def kalman_smooth(z: np.ndarray, noise: float = 1.0, q: float = 0.001, start: Sequence[float] = (0.0, 1.0), variance: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Filtered and smoothed (Rauch-Tung-Striebel) states of a series, shape (n, 2)."""
    f, qm = kalman_matrices(q)
    x, p, n = np.array(start, dtype=float), np.eye(2) * variance, len(z)
    xs, ps, xp, pp = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
    for i, v in enumerate(z):
        x, p = f @ x, f @ p @ f.T + qm
        xp[i], pp[i] = x, p
        gain = p[:, 0] / (p[0, 0] + noise)
        x, p = x + gain * (v - x[0]), p - np.outer(gain, p[0])
        xs[i], ps[i] = x, p
    sm = xs.copy()
    for i in range(n - 2, -1, -1):
        g = ps[i] @ f.T @ np.linalg.inv(pp[i + 1])
        sm[i] = xs[i] + g @ (sm[i + 1] - xp[i + 1])
    return xs, sm


class LagSmoother:
    """Fixed-lag smoother: after each value, the state ``lag`` steps ago is smoothed with what has come since."""

    def __init__(self, lag: int = 4, noise: float = 5.0, q: float = 0.001, start: Sequence[float] = (0.0, 0.5), variance: float = 200.0) -> None:
        self.lag, self.noise, self.x, self.p = lag, noise, np.array(start, dtype=float), np.eye(2) * variance
        self.f, self.q = kalman_matrices(q)
        self.recent: list[tuple] = []
        self.out: list[tuple] = []

    def feed(self, columns):
        ready_ts, ready = [], []
        for ts, z in zip(columns["_ts"].tolist(), columns["_x"].tolist()):
            xp, pp = self.f @ self.x, self.f @ self.p @ self.f.T + self.q
            gain = pp[:, 0] / (pp[0, 0] + self.noise)
            self.x, self.p = xp + gain * (z - xp[0]), pp - np.outer(gain, pp[0])
            self.recent.append((ts, self.x, self.p, xp, pp))
            if len(self.recent) > self.lag:
                ready_ts.append(self.recent[0][0])
                ready.append(self._smooth()[0])
                self.recent.pop(0)
        return {"_ts": np.array(ready_ts), "smoothed": np.array([x[0] for x in ready]), "slope": np.array([x[1] for x in ready])} if ready else {}

    def _smooth(self) -> list[np.ndarray]:
        s = [r[1] for r in self.recent]
        for i in range(len(s) - 2, -1, -1):
            _, x, p, _, _ = self.recent[i]
            _, _, _, xp, pp = self.recent[i + 1]
            s[i] = x + p @ self.f.T @ np.linalg.inv(pp) @ (s[i + 1] - xp)
        return s

    def finish(self):
        if not self.recent:
            return {}
        s = self._smooth()
        return {"_ts": np.array([r[0] for r in self.recent]), "smoothed": np.array([x[0] for x in s]), "slope": np.array([x[1] for x in s])}


def kalman_lag_smoother(df: DataFrame, keys: Sequence[str], order: str, value: str, lag: int = 4) -> DataFrame:
    """keys, order, ``smoothed`` and ``slope`` of a constant-velocity model, in bounded memory."""
    rows = df.select(*keys, F.col(order).alias("_ts"), F.col(value).cast("double").alias("_x"))
    kind = rows.schema["_ts"].dataType.simpleString()
    return fold(rows, keys, ["_ts"], ["_ts", "_x"], lambda: LagSmoother(lag), f"_ts {kind}, smoothed double, slope double").withColumnRenamed("_ts", order)


class _Forward:
    """Kalman filter of a constant-velocity model: after each value the state, its covariance and their predictions. A NaN only moves time on."""

    def __init__(self, noise: float, q: float, start: Sequence[float], variance: float) -> None:
        self.noise, self.x, self.p = noise, np.array(start, dtype=float), np.eye(2) * variance
        self.f, self.q = kalman_matrices(q)

    def feed(self, columns):
        out = []
        for z in columns["_x"].astype(float):
            xp, pp = self.f @ self.x, self.f @ self.p @ self.f.T + self.q
            self.x, self.p = xp, pp
            if z == z:
                gain = pp[:, 0] / (pp[0, 0] + self.noise)
                self.x, self.p = xp + gain * (z - xp[0]), pp - np.outer(gain, pp[0])
            out.append((*self.x, self.p[0, 0], self.p[0, 1], self.p[1, 1], *xp, pp[0, 0], pp[0, 1], pp[1, 1]))
        return {"_ts": columns["_ts"]} | {n: np.array(c) for n, c in zip(_KALMAN, zip(*out))}

    def finish(self):
        return {}


class _Backward:
    """Rauch-Tung-Striebel smoother over the filter's rows, latest first."""

    def __init__(self, q: float) -> None:
        self.f, self.s, self.next = kalman_matrices(q)[0], None, None

    def feed(self, columns):
        c, out = {n: columns[n] for n in _KALMAN}, []
        for i in range(len(columns["_ts"])):
            x = np.array([c["level"][i], c["slope"][i]])
            if self.s is not None:
                p = np.array([[c["p00"][i], c["p01"][i]], [c["p01"][i], c["p11"][i]]])
                xp, pp = self.next
                x = x + p @ self.f.T @ np.linalg.inv(pp) @ (self.s - xp)
            self.s = x
            self.next = np.array([c["xp0"][i], c["xp1"][i]]), np.array([[c["pp00"][i], c["pp01"][i]], [c["pp01"][i], c["pp11"][i]]])
            out.append((c["level"][i], c["slope"][i], *x))
        return {"_ts": -columns["_ts"]} | {n: np.array(v) for n, v in zip(("level", "slope", "smooth_level", "smooth_slope"), zip(*out))}

    def finish(self):
        return {}


_KALMAN = ("level", "slope", "p00", "p01", "p11", "xp0", "xp1", "pp00", "pp01", "pp11")


def kalman_states(df: DataFrame, keys: Sequence[str], order: str, value: str, noise: float = 1.0, q: float = 0.001, start: Sequence[float] = (0.0, 1.0), variance: float = 10.0) -> DataFrame:
    """keys, order (a whole number, unique in a series), the filtered ``level`` and ``slope`` and the smoothed ``smooth_level`` and ``smooth_slope`` of a
    constant-velocity model. Two folds in constant memory: the filter runs forward, the smoother backward over the filter's rows.
    A null value has no observation; an empty table gives no rows."""
    rows = df.select(*keys, F.col(order).cast("bigint").alias("_ts"), F.col(value).cast("double").alias("_x"))
    forward = fold(rows, keys, ["_ts"], ["_ts", "_x"], lambda: _Forward(noise, q, start, variance), "_ts bigint, " + ", ".join(f"{n} double" for n in _KALMAN))
    back = forward.withColumn("_ts", -F.col("_ts"))
    out = fold(back, keys, ["_ts"], ["_ts", *_KALMAN], lambda: _Backward(q), "_ts bigint, level double, slope double, smooth_level double, smooth_slope double")
    return out.withColumnRenamed("_ts", order)
