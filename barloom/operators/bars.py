"""Information bars from ticks: time, tick, volume, dollar, imbalance and run bars.

Ticks have keys, ``ts``, a tie-break ``seq`` that makes their order total, ``price`` and ``volume``. The trailing partial bar is never
emitted. Time and tick bars are plain aggregates over positions and buckets. The others reset on a threshold and discard the
overshoot, so they are ordered folds (barloom.fold); the machines find each bar's end with cumulative sums, and batch and
streaming share them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.fold import fold
from barloom.ordering import running, with_position

BAR_COLUMNS = "date_time timestamp, tick_num bigint, open double, high double, low double, close double, volume double, cum_buy_volume double, cum_ticks bigint, cum_dollar_value double"
TRACE_COLUMNS = "threshold double, cum_theta double"
METRICS = ("tick", "volume", "dollar")


def tick_signs(ticks: DataFrame, keys: Sequence[str], ts: str = "ts", tie: Sequence[str] = ("seq",), price: str = "price", first: int = 0) -> DataFrame:
    """Adds ``sign``: the direction of the last price change up to the tick, ``first`` before any change."""
    previous = running(ticks, keys, ts, tie, {"_before": ("last", price)}, inclusive=False)
    moved = previous.withColumn("_move", F.when(F.col(price) > F.col("_before"), 1).when(F.col(price) < F.col("_before"), -1))
    return running(moved, keys, ts, tie, {"_sign": ("last", "_move")}).withColumn("sign", F.coalesce("_sign", F.lit(first))).drop("_before", "_move", "_sign")


def _bar_aggregates(order: Column) -> list[Column]:
    price, volume = F.col("price"), F.col("volume")
    return [
        F.min(F.struct(order.alias("o"), price.alias("p")))["p"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(F.struct(order.alias("o"), price.alias("p")))["p"].alias("close"), F.sum("volume").alias("volume"),
        F.sum(F.when(F.col("sign") == 1, volume).otherwise(0.0)).alias("cum_buy_volume"), F.count(F.lit(1)).alias("cum_ticks"), F.sum(price * volume).alias("cum_dollar_value"),
    ]


def tick_bars(ticks: DataFrame, keys: Sequence[str] = ("instrument",), threshold: int = 600) -> DataFrame:
    """A bar per ``threshold`` ticks."""
    n = max(int(-(-threshold // 1)), 1)
    rows = with_position(tick_signs(ticks, keys), keys, "ts", ["seq"])
    bars = rows.withColumn("_bar", F.floor(F.col("_pos") / n)).groupBy(*keys, "_bar").agg(F.max("ts").alias("date_time"), (F.max("_pos") + 1).alias("tick_num"), *_bar_aggregates(F.col("_pos")))
    return bars.where(F.col("cum_ticks") == n).drop("_bar")


def time_bars(ticks: DataFrame, keys: Sequence[str] = ("instrument",), seconds: int = 86400) -> DataFrame:
    """A bar per bucket of ``seconds``; ``date_time`` is the bucket's end in epoch seconds and ``tick_num`` counts the tick that closes it,
    the first of a later bucket. Empty buckets and the last one give no bar."""
    rows = with_position(tick_signs(ticks, keys), keys, "ts", ["seq"])
    bucket = (F.floor(F.floor(F.unix_micros("ts") / 1_000_000) / seconds) + 1) * seconds
    bars = rows.withColumn("_bar", bucket).groupBy(*keys, "_bar").agg((F.max("_pos") + 2).alias("tick_num"), *_bar_aggregates(F.col("_pos")))
    last = bars.groupBy(*keys).agg(F.max("_bar").alias("_last"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    kept = bars.alias("b").join(last.alias("l"), [*same, F.col("b._bar") == F.col("l._last")], "left_anti")
    return kept.withColumnRenamed("_bar", "date_time")


class _Open:
    """The aggregates of the bar that is being built."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.ticks, self.open, self.high, self.low = 0, np.nan, -np.inf, np.inf
        self.volume = self.buy = self.dollar = 0.0

    def add(self, price: np.ndarray, volume: np.ndarray, sign: np.ndarray) -> None:
        if not len(price):
            return
        if not self.ticks:
            self.open = price[0]
        self.ticks += len(price)
        self.high, self.low = max(self.high, price.max()), min(self.low, price.min())
        total = lambda start, x: np.add.accumulate(np.concatenate([[start], x]))[-1]  # noqa: E731  (in order, as a fold adds)
        self.volume, self.dollar, self.buy = total(self.volume, volume), total(self.dollar, price * volume), total(self.buy, volume[sign == 1])


class BarMachine:
    """Reads ticks, asks ``_end`` where the current bar closes, and emits bars."""

    def __init__(self, metric: str) -> None:
        if metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")
        self.metric, self.price, self.sign, self.tick_num, self.bar = metric, np.nan, 0, 0, _Open()

    def _signs(self, price: np.ndarray) -> np.ndarray:
        move = np.sign(np.diff(np.concatenate([[self.price], price])))
        move[np.isnan(move)] = 0
        at = np.where(move != 0, np.arange(len(move)), -1)
        at = np.maximum.accumulate(at)
        return np.where(at >= 0, move[np.maximum(at, 0)], self.sign)

    def _amount(self, price: np.ndarray, volume: np.ndarray) -> np.ndarray:
        return {"tick": np.ones(len(price)), "volume": volume, "dollar": price * volume}[self.metric]

    def _end(self, price: np.ndarray, volume: np.ndarray, sign: np.ndarray) -> int | None:
        """How many of the ticks still belong to the current bar if it closes among them, else None; the ticks count as seen."""
        raise NotImplementedError

    def _closed(self) -> tuple[float, float]:
        """After a bar: resets, and returns the threshold it broke and by what."""
        raise NotImplementedError

    def feed(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ts, price, volume = columns["ts"], columns["price"].astype(float), columns["volume"].astype(float)
        sign = self._signs(price)
        rows, start = [], 0
        while start < len(price):
            n = self._end(price[start:], volume[start:], sign[start:])
            stop = len(price) if n is None else start + n
            self.bar.add(price[start:stop], volume[start:stop], sign[start:stop])
            self.tick_num += stop - start
            if n is not None:
                b = self.bar
                rows.append((ts[stop - 1], self.tick_num, b.open, b.high, b.low, price[stop - 1], b.volume, b.buy, b.ticks, b.dollar, *self._closed()))
                b.reset()
            start = stop
        if len(price):
            self.price, self.sign = price[-1], sign[-1]
        names = [c.split()[0] for c in f"{BAR_COLUMNS}, {TRACE_COLUMNS}".split(", ")]
        return {n: np.array(c) for n, c in zip(names, zip(*rows))} if rows else {}

    def finish(self) -> dict[str, np.ndarray]:
        return {}


class ThresholdBars(BarMachine):
    """Closes when the cumulated metric reaches the threshold."""

    def __init__(self, metric: str, threshold: float) -> None:
        super().__init__(metric)
        self.threshold, self.sum = threshold, 0.0

    def _end(self, price: np.ndarray, volume: np.ndarray, sign: np.ndarray) -> int | None:
        amount, start, size = self._amount(price, volume), 0, 256
        while start < len(amount):
            sums = np.add.accumulate(np.concatenate([[self.sum], amount[start : start + size]]))[1:]
            hit = np.flatnonzero(sums >= self.threshold)
            if len(hit):
                self.sum = sums[hit[0]]
                return start + int(hit[0]) + 1
            self.sum, start, size = sums[-1], start + len(sums), size * 2
        return None

    def _closed(self) -> tuple[float, float]:
        reached, self.sum = self.sum, 0.0
        return float(self.threshold), float(reached)


def ewma_last(x: np.ndarray, window: int) -> float:
    """The last value of the exponentially weighted mean with alpha = 2 / (window + 1) and adjusted weights."""
    w = (1 - 2 / (window + 1)) ** np.arange(len(x) - 1, -1, -1.0)
    return float((w * x).sum() / w.sum())


@dataclass(frozen=True)
class Expectation:
    """``constant``: the expected number of ticks stays at ``ticks``; else it is the EWMA of the last ``previous_bars`` lengths within
    ``bounds``. ``window``: how many imbalances the expected imbalance looks back on."""

    window: int = 10_000
    ticks: float = 20_000
    previous_bars: int = 3
    bounds: tuple[float, float] = (0.0, float("inf"))
    constant: bool = False


class _Expecting(BarMachine):
    def __init__(self, metric: str, expectation: Expectation) -> None:
        super().__init__(metric)
        self.e, self.ticks, self.lengths, self.any = expectation, float(expectation.ticks), [], False

    def _next_ticks(self, length: int) -> None:
        self.lengths = [*self.lengths, float(length)][-self.e.previous_bars :]
        if not self.e.constant:
            lo, hi = self.e.bounds
            self.ticks = min(max(ewma_last(np.array(self.lengths), self.e.previous_bars), lo), hi)


class ImbalanceBars(_Expecting):
    """Closes when |sum of signed amounts| exceeds expected ticks x |expected imbalance|."""

    def __init__(self, metric: str, expectation: Expectation) -> None:
        super().__init__(metric, expectation)
        self.theta, self.expected, self.seen, self.recent = 0.0, np.nan, 0, np.zeros(0)

    def _remember(self, x: np.ndarray) -> None:
        self.seen += len(x)
        self.recent = np.concatenate([self.recent, x])[-self.e.window :]

    def _expect(self) -> None:
        self.expected = np.nan if self.seen < self.ticks else ewma_last(self.recent, min(self.seen, self.e.window))

    def _end(self, price: np.ndarray, volume: np.ndarray, sign: np.ndarray) -> int | None:
        x, at = self._amount(price, volume) * sign, 0
        if not self.any and np.isnan(self.expected):
            at = max(int(np.ceil(self.ticks)) - self.seen, 1)
            self._remember(x[:at])
            self.theta = np.add.accumulate(np.concatenate([[self.theta], x[:at]]))[-1]
            if at > len(x):
                return None
            self._expect()
            if abs(self.theta) > self.ticks * abs(self.expected):
                return at
        limit, size = self.ticks * abs(self.expected), 256
        while at < len(x):
            sums = np.add.accumulate(np.concatenate([[self.theta], x[at : at + size]]))[1:]
            hit = np.flatnonzero(np.abs(sums) > limit)
            n = int(hit[0]) + 1 if len(hit) else len(sums)
            self.theta = sums[n - 1]
            self._remember(x[at : at + n])
            at += n
            if len(hit):
                return at
            size *= 2
        return None

    def _closed(self) -> tuple[float, float]:
        trace = (self.ticks * abs(self.expected), float(self.theta))
        self.any = True
        self._next_ticks(self.bar.ticks)
        self._expect()
        self.theta = 0.0
        return trace


class RunBars(_Expecting):
    """Closes when the larger of the buys' and the sells' amounts exceeds expected ticks x the larger expected run."""

    def __init__(self, metric: str, expectation: Expectation) -> None:
        super().__init__(metric, expectation)
        self.theta, self.buys, self.expected, self.share = [0.0, 0.0], 0, [np.nan, np.nan], np.nan
        self.seen, self.recent, self.shares, self.n = [0, 0], [np.zeros(0), np.zeros(0)], [], 0

    def _remember(self, side: int, x: np.ndarray) -> None:
        self.seen[side] += len(x)
        self.recent[side] = np.concatenate([self.recent[side], x])[-self.e.window :]

    def _expect(self) -> None:
        self.expected = [ewma_last(r, min(s, self.e.window)) if s else np.nan for r, s in zip(self.recent, self.seen)]

    def _take(self, x: np.ndarray) -> None:
        for side, part in ((0, x[x > 0]), (1, -x[x < 0])):
            self._remember(side, part)
            self.theta[side] = np.add.accumulate(np.concatenate([[self.theta[side]], part]))[-1]
        self.buys += int((x > 0).sum())
        self.n += len(x)

    def _end(self, price: np.ndarray, volume: np.ndarray, sign: np.ndarray) -> int | None:
        x = self._amount(price, volume) * sign
        at = 0
        if not self.any and np.isnan(self.expected).any():
            ready = (self.seen[0] + np.cumsum(x > 0) >= self.ticks) & (self.seen[1] + np.cumsum(x < 0) >= self.ticks)
            hit = np.flatnonzero(ready)
            if not len(hit):
                self._take(x)
                return None
            at = int(hit[0]) + 1
            self._take(x[:at])
            self._expect()
            self.share = self.buys / self.n
            if max(self.theta) > self._limit():
                return at
        limit, size = self._limit(), 256
        while at < len(x):
            part = x[at : at + size]
            buy = np.add.accumulate(np.concatenate([[self.theta[0]], np.where(part > 0, part, 0.0)]))[1:]
            sell = np.add.accumulate(np.concatenate([[self.theta[1]], np.where(part < 0, -part, 0.0)]))[1:]
            hit = np.flatnonzero(np.maximum(buy, sell) > limit)
            n = int(hit[0]) + 1 if len(hit) else len(part)
            self._take(part[:n])
            at += n
            if len(hit):
                return at
            size *= 2
        return None

    def _limit(self) -> float:
        return self.ticks * max(self.expected[0] * self.share, self.expected[1] * (1 - self.share))

    def _closed(self) -> tuple[float, float]:
        trace = (self._limit(), max(self.theta))
        self.any = True
        self.shares = [*self.shares, self.buys / self.bar.ticks][-self.e.previous_bars :]
        self._next_ticks(self.bar.ticks)
        self.share = ewma_last(np.array(self.shares), self.e.previous_bars)
        self._expect()
        self.theta, self.buys, self.n = [0.0, 0.0], 0, 0
        return trace


def machine_bars(ticks: DataFrame, keys: Sequence[str], machine, trace: bool = False) -> DataFrame:
    """Bars of a machine; with ``trace`` also the ``threshold`` each bar broke and the ``cum_theta`` that broke it."""
    bars = fold(ticks, keys, ["ts", "seq"], ["ts", "price", "volume"], machine, f"{BAR_COLUMNS}, {TRACE_COLUMNS}")
    return bars if trace else bars.drop("threshold", "cum_theta")


def volume_bars(ticks: DataFrame, keys: Sequence[str] = ("instrument",), threshold: float = 10_000) -> DataFrame:
    return machine_bars(ticks, keys, lambda: ThresholdBars("volume", threshold))


def dollar_bars(ticks: DataFrame, keys: Sequence[str] = ("instrument",), threshold: float = 1_000_000) -> DataFrame:
    return machine_bars(ticks, keys, lambda: ThresholdBars("dollar", threshold))


def imbalance_bars(ticks: DataFrame, metric: str, keys: Sequence[str] = ("instrument",), expectation: Expectation = Expectation(), trace: bool = False) -> DataFrame:
    return machine_bars(ticks, keys, lambda: ImbalanceBars(metric, expectation), trace)


def run_bars(ticks: DataFrame, metric: str, keys: Sequence[str] = ("instrument",), expectation: Expectation = Expectation(), trace: bool = False) -> DataFrame:
    return machine_bars(ticks, keys, lambda: RunBars(metric, expectation), trace)


@dataclass(frozen=True)
class BarFeature:
    """A named aggregate over the ticks of a bar: a Column of aggregates over ``price``, ``volume``, ``sign``, ``seq`` and ``ts``."""

    name: str
    aggregate: Column = field(compare=False)


def bar_function(name: str, fn: Callable[[dict[str, np.ndarray]], float], columns: Sequence[str] = ("price", "volume", "sign")) -> BarFeature:
    """A feature by a function of a bar's ticks: it gets ``columns`` as arrays of numbers in the order of (ts, seq) and returns a number. The ticks of one bar meet in one
    row, so bars must be bounded, as tick bars are; a Column is the faster way where there is one."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "seq", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])))
    lists = [F.transform(ordered, lambda x: x[f"_v{i}"]) for i in range(len(columns))]  # noqa: B023

    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(dict(zip(columns, map(np.asarray, row)))) for row in zip(*series)], dtype=float)

    return BarFeature(name, apply(*lists))


def bars_with_features(ticks: DataFrame, bars: DataFrame, features: Sequence[BarFeature], keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """``bars`` with further aggregates of their ticks. A tick belongs to the first bar whose ``tick_num`` is not below its own number;
    bars cover the positions without gaps, so bar bounds are ranges that are exploded by position block and joined by equality."""
    rows = with_position(tick_signs(ticks, keys), keys, "ts", ["seq"])
    step = 4096
    spans = bars.select(*keys, F.col("tick_num").alias("_to"), (F.col("tick_num") - F.col("cum_ticks")).alias("_from"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))))
    t, s = rows.withColumn("_cell", F.floor(F.col("_pos") / step)).alias("t"), spans.alias("s")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_cell"]]
    inside = t.join(s, [*same, F.col("t._pos") >= F.col("s._from"), F.col("t._pos") < F.col("s._to")]).select("t.*", F.col("s._to").alias("tick_num"))
    extra = inside.groupBy(*keys, "tick_num").agg(*[f.aggregate.alias(f.name) for f in features])
    return bars.join(extra, [*keys, "tick_num"], "left")


def quotes_per_timestamp(ticks: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """Open, high, low, close, volume and the volumes of buys (up-ticks) and sells per timestamp."""
    rows = tick_signs(ticks, keys)
    return rows.groupBy(*keys, "ts").agg(
        F.min(F.struct("seq", "price"))["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(F.struct("seq", "price"))["price"].alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.when(F.col("sign") > 0, F.col("volume")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(F.col("sign") < 0, F.col("volume")).otherwise(0.0)).alias("sell_volume"),
    )


def resample(ticks: DataFrame, keys: Sequence[str], seconds: int, value: str = "price") -> DataFrame:
    """Last value and count per bucket, empty buckets between a series' first and last included (null and 0)."""
    bucket = F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds
    full = ticks.groupBy(*keys, bucket.alias("bucket")).agg(F.max(F.struct("ts", "seq", F.col(value).alias("v")))["v"].alias("last"), F.count(F.lit(1)).alias("n"))
    nxt = F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket"))
    spans = full.withColumn("_to", F.coalesce(nxt - seconds, F.col("bucket")))
    each = spans.select(*keys, "bucket", "last", "n", F.explode(F.sequence("bucket", "_to", F.lit(seconds).cast("bigint"))).alias("_b"))
    here = F.col("_b") == F.col("bucket")
    return each.select(*keys, F.col("_b").alias("bucket"), F.when(here, F.col("last")).alias("last"), F.when(here, F.col("n")).otherwise(0).alias("n"))
