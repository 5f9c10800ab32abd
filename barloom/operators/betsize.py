"""Bet sizes from probabilities, price divergence, budgets and concurrent positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.selection import quantile_list
from barloom.functions.special import norm_cdf, phi, sign
from barloom.joins import asof_join, sweep
from barloom.numeric.optimize import nelder_mead
from barloom.operators.ml import isotonic_calibration
from barloom.ordering import running
from barloom.shared import materialize


def _z(p: Column, classes: int) -> Column:
    return F.try_divide(p - 1 / classes, F.sqrt(p * (1 - p)))


def clipped_cdf_size(prob: Column) -> Column:
    """The normal probability of the two-class z statistic; 0 below a half. Probabilities of 0 and 1 are moved inside by 1e-5."""
    return _clipped(norm_cdf(_inner_z(prob)))


def _inner_z(prob: Column) -> Column:
    return _z(F.when(prob == 1, F.lit(0.99999)).when(prob == 0, F.lit(0.00001)).otherwise(prob), 2)


def _clipped(size: Column) -> Column:
    return F.when(size < 0.5, F.lit(0.0)).otherwise(size)


def signal(prob: Column, classes: int = 2, prediction: Column | None = None) -> Column:
    """Prediction x (2 Phi(z) - 1)."""
    s = 2 * norm_cdf(_z(prob, classes)) - 1
    return s if prediction is None else prediction * s


def discrete(s: Column, step: float) -> Column:
    """Rounded to multiples of the step, halves to even, within [-1, 1]."""
    r = F.bround(s / step, 0) * step
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def average_active(signals: DataFrame, keys: Sequence[str], value: str = "signal") -> DataFrame:
    """keys, ``at`` and ``signal``: at each start and end of a signal, the mean of those that live (t0 <= at < t1, or t1 null), 0 where none does."""
    at = signals.select(*keys, F.explode(F.array_compact(F.array("t0", "t1"))).alias("at")).distinct()
    out = sweep(at, signals, keys, "at", "t0", "t1", {"_s": F.col(value), "_n": F.lit(1.0)}, closed=False)
    return out.select(*keys, "at", F.when(F.round("_n") > 0, F.col("_s") / F.round("_n")).otherwise(F.lit(0.0)).alias("signal"))


def bet_size_from_probability(events: DataFrame, keys: Sequence[str], classes: int = 2, step: float = 0.0, averaged: bool = False, prob: str = "prob", prediction: str | None = None) -> DataFrame:
    """keys, ``at`` and ``bet_size`` of events with t0, t1 and a probability."""
    s = events.withColumn("signal", signal(F.col(prob), classes, F.col(prediction) if prediction else None))
    s = average_active(s, keys) if averaged else s.select(*keys, F.col("t0").alias("at"), "signal")
    return s.select(*keys, "at", (discrete(F.col("signal"), abs(step)) if step else F.col("signal")).alias("bet_size"))


def concurrent_sides(bets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """bets (t0, t1, side) with ``active_long`` and ``active_short``: bets of each side with t0' <= t0 < t1'."""
    ends = bets.where(F.col("t1").isNotNull())
    sides = {"_long": F.when(F.col("side") > 0, 1).otherwise(0), "_short": F.when(F.col("side") < 0, 1).otherwise(0)}
    out = sweep(bets, ends, keys, "t0", "t0", "t1", sides, closed=False)
    return out.select(*bets.columns, F.col("_long").cast("bigint").alias("active_long"), F.col("_short").cast("bigint").alias("active_short"))


def budget_size(bets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``concurrent_sides`` with ``bet_size``: active longs over their maximum less active shorts over theirs."""
    rows = concurrent_sides(bets, keys)
    most = rows.groupBy(*keys).agg(F.max("active_long").alias("_ml"), F.max("active_short").alias("_ms"))
    part = lambda a, m: F.when(F.col(m) > 0, F.col(a) / F.col(m)).otherwise(F.lit(0.0))
    return rows.join(most, list(keys)).withColumn("bet_size", part("active_long", "_ml") - part("active_short", "_ms")).drop("_ml", "_ms")


# Sizes as a function of the divergence of forecast and market price.


def size(divergence: Column, w: float, kind: str = "sigmoid") -> Column:
    if kind == "sigmoid":
        return divergence / F.sqrt(w + divergence * divergence)
    if kind != "power":
        raise ValueError("kind is sigmoid or power")
    inside = F.when(F.abs(divergence) <= 1, F.signum(divergence) * F.pow(F.abs(divergence), F.lit(w)))
    return F.when(divergence == 0, F.lit(0.0)).otherwise(inside)


def target_position(w: float, forecast: Column, market: Column, most: Column, kind: str = "sigmoid") -> Column:
    """Truncated to whole units."""
    return (size(forecast - market, w, kind) * most).cast("int")


def inverse_price(forecast: Column, w: float, m: Column, kind: str = "sigmoid") -> Column:
    """The market price at which the size is m."""
    if kind == "sigmoid":
        return forecast - m * F.sqrt(F.lit(w) / (1 - m * m))
    return F.when(m == 0, forecast).otherwise(forecast - F.signum(m) * F.pow(F.abs(m), F.lit(1 / w)))


def limit_price(target: Column, position: Column, forecast: Column, w: float, most: Column, kind: str = "sigmoid") -> Column:
    """The mean break-even price of the unit steps from the position to the target; null if they are equal or the steps are not ascending."""
    t, p = target.cast("int"), position.cast("int")
    first, last = F.abs(p + F.signum(t - p).cast("int")), F.abs(t + 1) - 1
    total = F.when(last >= first, F.aggregate(F.sequence(first, F.greatest(last, first)), F.lit(0.0), lambda a, j: a + inverse_price(forecast, w, j / most, kind))).otherwise(F.lit(0.0))
    return F.when(t != p, total / F.abs(t - p))


def calibrate(divergence: float, m: float, kind: str = "sigmoid") -> float:
    """The w for which the divergence gives size m."""
    if kind == "sigmoid":
        return divergence**2 * (m**-2 - 1)
    if not -1 <= divergence <= 1:
        raise ValueError("a power size needs a divergence within [-1, 1]")
    return max(0.0, math.log(m / math.copysign(1, divergence)) / math.log(abs(divergence)))


def dynamic_size(df: DataFrame, position: str = "pos", most: str = "max_pos", market: str = "m_p", forecast: str = "f", divergence: float = 10, m: float = 0.95, kind: str = "sigmoid") -> DataFrame:
    """df with ``bet_size``, ``t_pos`` and ``l_p`` (limit price)."""
    w = calibrate(divergence, m, kind)
    f, p, n = F.col(forecast), F.col(market), F.col(most)
    out = df.withColumns({"bet_size": size(f - p, w, kind), "t_pos": target_position(w, f, p, n, kind)})
    return out.withColumn("l_p", limit_price(F.col("t_pos"), F.col(position), f, w, n, kind))


def mixture_cdf(x: Column, mu1: float, mu2: float, s1: float, s2: float, p1: float) -> Column:
    return p1 * norm_cdf((x - mu1) / s1) + (1 - p1) * norm_cdf((x - mu2) / s2)


def mixture_size(c: Column, parameters: Sequence[float]) -> Column:
    """The size of a net position from its two-normal distribution, 0 at 0."""
    mu1, mu2, s1, s2, p1 = parameters
    zero = p1 * phi(-mu1 / s1) + (1 - p1) * phi(-mu2 / s2)
    f = mixture_cdf(c, *parameters)
    return F.when(c >= 0, (f - zero) / (1 - zero)).otherwise((f - zero) / zero)


def kelly(p: Column, win: float, loss: float) -> Column:
    return p / abs(loss) - (1 - p) / win


def clipped_kelly(p: Column, win: float, loss: float) -> Column:
    k = kelly(p, win, loss)
    return F.when(k > 1, 1.0).when(k < 0, 0.0).otherwise(k)


def linear_scaling(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def ecdf_size(train: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """rows with ``bet_size``: the share of the training values at or below the value; 0 below all of them, null for a null value. Equal values are counted first; running
    counts over cells of the value and an as-of join of the distinct values do the rest, so no task holds the distribution."""
    known = train.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).cast("double").alias("_at")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    low, high, total = known.agg(F.min("_at"), F.max("_at"), F.sum("_n")).first()
    cell = max((high - low) / 1000, 1e-300) if total else 1.0
    sums = running(known, ["_k"], "_at", [], {"_sum": ("sum", "_n")}, cell_us=cell)
    asked = rows.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumn("_k", F.lit(0))
    found = asof_join(asked, sums, ["_k"], "_v", "_at", ["_sum"], cell_us=cell).select("_v", F.coalesce(F.col("_sum") / F.lit(float(total or 1)), F.lit(0.0)).alias("bet_size"))
    l, r = rows.alias("l"), found.alias("r")
    return l.join(r, F.col(f"l.{value}") == F.col("r._v"), "left").select("l.*", "r.bet_size")


def decile_calibration(rows: DataFrame, prob: str, target: str, ret: str, q: int = 10) -> DataFrame:
    """Per q-quantile of the probability: ``n``, mean probability, hit rate and the mean win and loss."""
    edges = quantile_list(rows, prob, [i / q for i in range(1, q)])
    bucket = sum([F.when(F.col(prob) > e, 1).otherwise(0) for e in edges], F.lit(0))
    mean = lambda c: F.avg(F.when(c, F.col(ret)))
    return rows.where(F.col(prob).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(target).cast("double")).alias("hit_rate"), mean(F.col(ret) > 0).alias("mean_win"), mean(F.col(ret) <= 0).alias("mean_loss"))


def all_or_nothing(p: Column) -> Column:
    return F.when(p > 0.5, 1.0).otherwise(0.0)


def signed_size(side: Column, magnitude: Column) -> Column:
    return sign(side) * magnitude


# Sizes fitted to a training set. Up to MAX_FIT pairs (probability, return) come to the driver; of more, each evaluation is an aggregate.

MAX_FIT = 2_000_000


def _ratio(x: np.ndarray) -> float:
    return float(x.mean() / x.std()) if len(x) and x.std() > 0 else -np.inf


def _loss(train: DataFrame, prob: str, ret: str, size: Callable[[np.ndarray, np.ndarray], np.ndarray], column: Callable[[list[float]], Column]) -> Callable[[np.ndarray], float]:
    """Less return per deviation, of parameters; ``column`` is ``size`` over a column ``p``."""
    rows = train.where(F.col(prob).isNotNull() & F.col(ret).isNotNull()).select(F.col(prob).cast("double").alias("p"), F.col(ret).cast("double").alias("r"))
    if rows.count() <= MAX_FIT:
        pdf = rows.toPandas()
        p, r = pdf.p.to_numpy(), pdf.r.to_numpy()
        return lambda v: -_ratio(size(v, p) * r)
    rows = materialize(rows, "pairs")

    def loss(v: np.ndarray) -> float:
        x = column([float(a) for a in v]) * F.col("r")
        s = rows.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
        return -float(s.m / s.s) if s.s and s.s > 0 else np.inf

    return loss


def optimal_linear(train: DataFrame, prob: str, ret: str) -> tuple[float, float]:
    """(a, b) of the size a p + b, within [0, 1], with the highest return per deviation."""
    loss = _loss(train, prob, ret, lambda v, p: np.clip(v[0] * p + v[1], 0, 1), lambda v: F.greatest(F.least(v[0] * F.col("p") + v[1], F.lit(1.0)), F.lit(0.0)))
    x, _ = nelder_mead(loss, [1.0, 0.0], steps=300)
    return float(x[0]), float(x[1])


def optimal_sigmoid(train: DataFrame, prob: str, ret: str) -> tuple[float, float]:
    """(a, b) of the size 1 / (1 + exp(-(a p + b))) with the highest return per deviation."""
    power = lambda v: F.greatest(F.least(-(v[0] * F.col("p") + v[1]), F.lit(50.0)), F.lit(-50.0))
    loss = _loss(train, prob, ret, lambda v, p: 1 / (1 + np.exp(np.clip(-(v[0] * p + v[1]), -50, 50))), lambda v: 1 / (1 + F.exp(power(v))))
    x, _ = nelder_mead(loss, [4.0, -2.0], [(-50, 50), (-50, 50)], steps=300)
    return float(x[0]), float(x[1])


def sizing_bakeoff(train: DataFrame, rows: DataFrame, prob: str = "prob", ret: str = "ret", periods: float = 252, label: str | None = None) -> DataFrame:
    """``method``, ``mean``, ``stdev`` and ``sharpe`` of the next return under each way of sizing: fitted on train, applied to rows in one pass. With a ``label`` (1 where
    the bet was right) also under each with the probability calibrated by isotonic regression on train, as ``<method>_isotonic``."""
    if label is not None:
        both = [isotonic_calibration(train, d, prob, label).drop(prob).withColumnRenamed("calibrated", prob) for d in (train, rows)]
        again = sizing_bakeoff(*both, prob, ret, periods)
        return sizing_bakeoff(train, rows, prob, ret, periods).unionByName(again.withColumn("method", F.concat("method", F.lit("_isotonic"))))
    p, r = F.col(prob), F.col(ret)
    la, lb = optimal_linear(train, prob, ret)
    sa, sb = optimal_sigmoid(train, prob, ret)
    low, high = train.agg(F.min(prob), F.max(prob)).first()
    # In stages: the distribution function of an expression would repeat it in every term.
    sized = ecdf_size(train, rows, prob).withColumnRenamed("bet_size", "_ecdf").withColumn("_z", _inner_z(p)).withColumn("_phi", norm_cdf(F.col("_z")))
    sizes = {
        "raw": p, "all_or_nothing": all_or_nothing(p), "linear": linear_scaling(p, F.lit(low), F.lit(high)), "optimal_linear": F.greatest(F.least(la * p + lb, F.lit(1.0)), F.lit(0.0)),
        "clipped_cdf": _clipped(F.col("_phi")), "ecdf": F.col("_ecdf"), "optimal_sigmoid": 1 / (1 + F.exp(-(sa * p + sb))), "buy_and_hold": F.lit(1.0),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), (s * r).alias("x")) for n, s in sizes.items()])).alias("_e")
    out = sized.select(each).groupBy(F.col("_e.method").alias("method")).agg(F.avg("_e.x").alias("mean"), F.stddev_samp("_e.x").alias("stdev"))
    return out.withColumn("sharpe", F.try_divide("mean", "stdev") * math.sqrt(periods))
