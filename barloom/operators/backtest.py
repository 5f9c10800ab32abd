"""Backtest statistics: bets, holding periods, concentration, drawdowns, Sharpe ratios and their significance, risk measures, scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.fold import fold
from barloom.functions.selection import exact_quantiles
from barloom.functions.special import EULER_GAMMA, norm_cdf, phi, phi_inverse
from barloom.ordering import running
from barloom.shared import materialize, small_side

DAY = 86_400_000_000


def flattenings_and_flips(positions: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys and ts where a position ends or changes sides (a first position of 0 counts), and each series' last time."""
    rows = running(positions, keys, ts, [], {"_before": ("last", value)}, inclusive=False)
    last = positions.groupBy(*keys).agg(F.max(ts).alias("_end"))
    rows = rows.join(last, list(keys))
    x, b = F.col(value), F.col("_before")
    return rows.where(((x == 0) & (b.isNull() | (b != 0))) | (x * b < 0) | (F.col(ts) == F.col("_end"))).select(*keys, ts)


class _Holding:
    """Weighted-average entry time of a position and the holding times of what leaves it; in days."""

    def __init__(self) -> None:
        self.start, self.before, self.entry, self.time, self.weight = None, 0.0, 0.0, 0.0, 0.0

    def feed(self, columns):
        for t, x in zip(columns["_ts"].tolist(), columns["_x"].tolist()):
            if self.start is None:
                self.start, self.before = t, x
                continue
            now, d = (t - self.start) / self.unit, x - self.before
            if d * self.before >= 0:
                if x != 0:
                    self.entry = (self.entry * self.before + now * d) / x
            else:
                w = abs(self.before) if x * self.before < 0 else abs(d)
                self.time += (now - self.entry) * w
                self.weight += w
                if x * self.before < 0:
                    self.entry = now
            self.before = x
        return {}

    unit = DAY

    def finish(self):
        return {"holding_days": np.array([self.time / self.weight if self.weight > 0 else np.nan])}


class _HoldingDays(_Holding):
    unit = 1


def average_holding_period(positions: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys and ``holding_days``; null without a closed position. ts is a timestamp, or a whole number of days."""
    rows = positions.select(*keys, F.col(ts).alias("_ts"), F.col(value).cast("double").alias("_x"))
    machine = _Holding if dict(rows.dtypes)["_ts"].startswith("timestamp") else _HoldingDays
    return fold(rows, keys, ["_ts"], ["_ts", "_x"], machine, "holding_days double")


def concentration(values: Column) -> Column:
    """Normalised Herfindahl index of the values' shares; null for two or fewer."""
    n, s = F.count(values), F.sum(values)
    hhi = F.try_divide(F.sum(values * values), s * s)
    return F.when(n > 2, (hhi - 1 / n) / (1 - 1 / n))


def bets_concentration(returns: DataFrame, keys: Sequence[str], month: Column, value: str = "ret") -> DataFrame:
    """keys, ``positive``, ``negative`` and ``time``: concentration of the gains, the losses and the number of bets per month."""
    r = F.col(value)
    signs = returns.groupBy(*keys).agg(concentration(F.when(r >= 0, r)).alias("positive"), concentration(F.when(r < 0, r)).alias("negative"))
    months = returns.groupBy(*keys, month.alias("_m")).agg(F.count(value).cast("double").alias("_n")).groupBy(*keys).agg(concentration(F.col("_n")).alias("time"))
    return signs.join(months, list(keys))


def drawdowns(returns: DataFrame, keys: Sequence[str], ts: str, value: str, days: Column, dollars: bool = False, cell_us: int = DAY) -> DataFrame:
    """One row per high-water mark that was followed by a loss: keys, ts (of the mark), ``hwm``, ``drawdown`` (a share of the mark, or ``dollars``) and
    ``years_under_water`` (to the next such mark; null for the last). ``days`` is the time in days."""
    rows = running(returns.withColumn("_days", days), keys, ts, [], {"hwm": ("max", value)}, cell_us=cell_us)
    marks = rows.groupBy(*keys, "hwm").agg(F.min(value).alias("_low"), F.min(ts).alias(ts), F.min("_days").alias("_at")).where(F.col("hwm") > F.col("_low"))
    nxt = F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at"))
    drop = F.col("hwm") - F.col("_low") if dollars else 1 - F.try_divide("_low", "hwm")
    return marks.select(*keys, ts, "hwm", drop.alias("drawdown"), ((nxt - F.col("_at")) / 365.25).alias("years_under_water"))


def sharpe(r: Column, periods: float = 252, risk_free: float = 0.0) -> Column:
    return F.try_divide(F.avg(r) - risk_free, F.stddev_samp(r)) * math.sqrt(periods)


def sharpe_statistics(returns: DataFrame, keys: Sequence[str], value: str = "ret", periods: float = 252, benchmark: float = 0.0, prob: float = 0.95) -> DataFrame:
    """One aggregate per group: ``n``, ``mean``, ``stdev``, ``sr`` (per period), ``annual_sr``, biased ``skew`` and ``kurt`` (3 for a normal), ``sr_std``, ``psr`` (probability that the
    true ratio exceeds the benchmark) and ``min_track_length``."""
    r = F.col(value)
    out = returns.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("stdev"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))
    out = out.withColumn("sr", F.try_divide(F.col("mean"), F.col("stdev")))
    sr, s, k, n = F.col("sr"), F.col("skew"), F.col("kurt"), F.col("n")
    out = out.withColumns({"annual_sr": sr * math.sqrt(periods), "sr_std": F.sqrt(F.try_divide(1 + 0.5 * sr * sr - s * sr + (k - 3) / 4 * sr * sr, (n - 1).cast("double")))})
    return out.withColumns({"psr": probabilistic_sharpe(sr, F.lit(benchmark), n, s, k), "min_track_length": 1 + F.col("sr_std") * F.col("sr_std") * (n - 1) * F.pow(F.try_divide(F.lit(phi_inverse(prob)), sr - benchmark), 2)})


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    return norm_cdf(F.try_divide((sr - benchmark) * F.sqrt((n - 1).cast("double")), F.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)))


def minimum_track_record(sr: float, benchmark: float, skew: float = 0.0, kurt: float = 3.0, alpha: float = 0.05) -> float:
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr**2) * (phi_inverse(1 - alpha) / (sr - benchmark)) ** 2


def expected_maximum(trials: float, mean: float = 0.0, std: float = 1.0) -> float:
    """The expected maximum of independent normal Sharpe ratios."""
    if trials <= 1:
        return mean
    return mean + std * ((1 - EULER_GAMMA) * phi_inverse(1 - 1 / trials) + EULER_GAMMA * phi_inverse(1 - 1 / (trials * math.e)))


def independent_trials(correlation: float, trials: int) -> int:
    return int(correlation + (1 - correlation) * trials) + 1


def deflated_sharpe(sr: float, estimates: Sequence[float], n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    """Probability that the best of several trials is no fluke."""
    bench = expected_maximum(len(estimates), 0.0, float(np.std(estimates)))
    return phi((sr - bench) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2))


def deflated_by_group(stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group of ``sharpe_statistics`` rows: ``trials``, ``best_sr``, ``benchmark`` and ``dsr`` of the best."""
    best = stats.where(F.col("sr").isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("trials"), F.stddev_pop("sr").alias("_std"), F.max(F.struct("sr", "n", "skew", "kurt")).alias("_b"))
    # The quantile has no Column form; it depends on the number of trials only.
    factor = F.pandas_udf(lambda s: s.map(lambda m: expected_maximum(m)), "double")
    out = best.withColumn("benchmark", F.col("_std") * factor(F.col("trials").cast("double")))
    b = F.col("_b")
    return out.select(*group, "trials", b["sr"].alias("best_sr"), "benchmark", probabilistic_sharpe(b["sr"], F.col("benchmark"), b["n"], b["skew"], b["kurt"]).alias("dsr"))


def skew_to_alpha(skew: float) -> float:
    a = abs(skew) ** (2 / 3)
    d = math.sqrt(math.pi / 2 * a / (a + ((4 - math.pi) / 2) ** (2 / 3)))
    return math.copysign(d / math.sqrt(1 - d * d), skew)


def z_statistic(sr: float, t: int, benchmark: float = 0.0, skew: float = 0.0, kurt: float = 3.0) -> float:
    return (sr - benchmark) * math.sqrt(t - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2)


def type_1_error(z: float, trials: int = 1) -> float:
    return 1 - (1 - phi(-z)) ** trials


def theta(sr: float, t: int, true_sr: float = 0.0, skew: float = 0.0, kurt: float = 3.0) -> float:
    return true_sr * math.sqrt(t - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2)


def type_2_error(alpha: float, trials: int, theta_: float) -> float:
    return phi(phi_inverse((1 - alpha) ** (1 / trials)) - theta_)


def implied_precision(stop: Column, profit: Column, freq: Column, target: Column) -> Column:
    """The hit rate that reaches the target Sharpe ratio with these outcomes and bets a year."""
    d, t2 = profit - stop, target * target
    a, b, c = (freq + t2) * d * d, (2 * freq * stop - t2 * d) * d, freq * stop * stop
    return F.try_divide(-b + F.sqrt(b * b - 4 * a * c), 2 * a)


def implied_frequency(stop: Column, profit: Column, p: Column, target: Column) -> Column:
    """Bets a year that reach the target with this hit rate."""
    d = profit - stop
    return F.try_divide(F.pow(target * d, 2) * p * (1 - p), F.pow(d * p + stop, 2))


def failure_probability(returns: DataFrame, keys: Sequence[str], freq: float, target: float, value: str = "ret") -> DataFrame:
    """keys, ``precision``, ``needed`` and ``risk``: the normal probability of the needed precision around the observed one, with scale p (1 - p)."""
    r = F.col(value)
    out = returns.groupBy(*keys).agg(F.avg(F.when(r > 0, r)).alias("_up"), F.avg(F.when(r <= 0, r)).alias("_down"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("precision"))
    out = out.withColumn("needed", implied_precision(F.col("_down"), F.col("_up"), F.lit(freq), F.lit(target)))
    p = F.col("precision")
    return out.select(*keys, "precision", "needed", norm_cdf(F.try_divide(F.col("needed") - p, p * (1 - p))).alias("risk"))


def ou_parameters(prices: DataFrame, keys: Sequence[str], order: str, close: str) -> DataFrame:
    """keys, ``forecast``, ``phi``, ``sigma`` and ``half_life`` of ln price regressed on its lagged deviation from the mean."""
    mean = prices.groupBy(*keys).agg(F.avg(F.ln(close)).alias("_m"))
    rows = running(prices.withColumn("_l", F.ln(close)), keys, order, [], {"_b": ("last", "_l")}, inclusive=False).where(F.col("_b").isNotNull())
    rows = rows.join(mean, list(keys)).withColumn("_x", F.col("_b") - F.col("_m"))
    fit = rows.groupBy(*keys).agg(F.regr_slope("_l", "_x").alias("phi"), F.regr_intercept("_l", "_x").alias("forecast"), F.var_pop("_l").alias("_vy"), F.var_pop("_x").alias("_vx"))
    half = F.when((F.col("phi") > 0) & (F.col("phi") != 1), -math.log(2) / F.ln("phi"))
    return fit.select(*keys, "forecast", "phi", F.sqrt(F.greatest(F.col("_vy") - F.col("phi") * F.col("phi") * F.col("_vx"), F.lit(0.0))).alias("sigma"), half.alias("half_life"))


# Risk of return series.


def value_at_risk(returns: DataFrame, keys: Sequence[str], value: str, level: float = 0.05) -> DataFrame:
    """keys, ``var`` (the level's quantile, the higher neighbour) and ``expected_shortfall`` (the mean below it; null if none is)."""
    var = small_side(materialize(exact_quantiles(returns, keys, value, [level], higher=True).select(*keys, F.col("value").alias("var")), "var"))
    rows = returns.where(F.col(value).isNotNull()).alias("r").join(var.alias("v"), [F.col(f"r.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys])
    below = F.when(F.col(f"r.{value}") < F.col("v.var"), F.col(f"r.{value}"))
    return rows.groupBy(*[F.col(f"r.{k}") for k in keys]).agg(F.max("v.var").alias("var"), F.avg(below).alias("expected_shortfall"))


def conditional_drawdown(levels: DataFrame, keys: Sequence[str], order: str, value: str, level: float = 0.05, cell_us: int = DAY) -> DataFrame:
    """keys and ``cdar``: the mean of the running maximum drawdown above its level's quantile (higher neighbour)."""
    rows = running(levels, keys, order, [], {"_top": ("max", value)}, cell_us=cell_us).withColumn("_dd", F.col("_top") - F.col(value))
    rows = running(rows, keys, order, [], {"_mdd": ("max", "_dd")}, cell_us=cell_us)
    q = value_at_risk(rows, keys, "_mdd", level).select(*keys, F.col("var").alias("_q"))
    return rows.join(q, list(keys)).groupBy(*keys).agg(F.avg(F.when(F.col("_mdd") > F.col("_q"), F.col("_mdd"))).alias("cdar"))


# Scores of predictions.


def classification_scores(rows: DataFrame, keys: Sequence[str], actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """keys, ``precision``, ``recall``, ``f1``, ``support``, ``accuracy``, ``auc``, ``macro_f1``, ``weighted_f1`` and ``specificity`` of two classes (0 where undefined)."""
    a, p = F.col(actual), F.col(predicted)
    count = lambda x, y: F.sum(F.when((a == x) & (p == y), 1).otherwise(0)).cast("double")
    c = rows.where(a.isin(0, 1) & p.isin(0, 1)).groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    f1, f0 = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)
    n1, n0 = tp + fn, tn + fp
    return c.select(
        *keys, div(tp, tp + fp).alias("precision"), div(tp, n1).alias("recall"), f1.alias("f1"), n1.cast("bigint").alias("support"), div(tp + tn, n1 + n0).alias("accuracy"),
        ((div(tp, n1) + div(tn, n0)) / 2).alias("auc"), ((f1 + f0) / 2).alias("macro_f1"), div(f1 * n1 + f0 * n0, n1 + n0).alias("weighted_f1"), div(tn, n0).alias("specificity"),
    )


def probability_weighted_accuracy(correct: Column, prob: Column, classes: int = 2) -> Column:
    """Sum of (p - 1/K) over correct predictions over the sum of all; 0 where that is 0."""
    edge = prob - 1 / classes
    return F.coalesce(F.try_divide(F.sum(correct * edge), F.sum(edge)), F.lit(0.0))


def profit_score(actual: Column, prob: Column, threshold: float = 0.5, profit: float = 100, loss: float = -100) -> Column:
    return F.sum(F.when((prob > threshold).cast("int") == actual, profit).otherwise(loss))


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def equity_curve(returns: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """returns with ``equity``, the product of 1 + return up to the row (returns above -1)."""
    return running(returns.withColumn("_lr", F.ln(1 + F.col(value))), keys, order, [], {"_s": ("sum", "_lr")}).withColumn("equity", F.exp("_s")).drop("_lr", "_s")


def maximum_sharpe_errors(trials: Sequence[int], outer: int = 10, inner: int = 100, std: float = 1.0, mean: float = 0.0, seed: int = 0) -> list[tuple[int, float, float]]:
    """(trials, mean error, deviation of error) of the expected maximum Sharpe ratio against simulated ones."""
    out = []
    for n in trials:
        rng, want, errors = np.random.default_rng([seed, n]), expected_maximum(n, mean, std), []
        for _ in range(outer):
            x = rng.standard_normal((inner, n))
            x = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
            errors.append((mean + std * x.max(axis=1)).mean() / want - 1)
        out.append((n, float(np.mean(errors)), float(np.std(errors, ddof=1)) if outer > 1 else 0.0))
    return out


def psr_optimum(returns: np.ndarray, start: Sequence[float] | None = None, bounds: Sequence[tuple[float, float]] | None = None, steps: int = 2000, rate: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights (summing to 1, within bounds) that maximise the Sharpe ratio in units of its standard error, by projected gradient ascent: the ratio, its skewness
    and kurtosis are differentiated through the portfolio's central moments. Returns are rows of dates by columns of assets."""
    n, k = returns.shape
    w = np.full(k, 1 / k) if start is None else np.asarray(start, dtype=float)
    low, high = np.array(bounds or [(0.0, 1.0)] * k).T
    x = returns - returns.mean(axis=0)
    mu = returns.mean(axis=0)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        r = x @ w
        m2, m3, m4 = (r**2).mean(), (r**3).mean(), (r**4).mean()
        d2, d3, d4 = (p * (x * (r ** (p - 1))[:, None]).mean(axis=0) for p in (2, 3, 4))
        s = math.sqrt(m2)
        sr, skew, kurt = mu @ w / s, m3 / s**3, m4 / m2**2
        d_sr = mu / s - mu @ w * d2 / (2 * s**3)
        d_skew, d_kurt = d3 / s**3 - 1.5 * m3 * d2 / s**5, d4 / m2**2 - 2 * m4 * d2 / m2**3
        v = max((1 - sr * skew + sr**2 * (kurt - 1) / 4) / (n - 1), 1e-300)
        d_v = (-d_sr * skew - sr * d_skew + sr * d_sr * (kurt - 1) / 2 + sr**2 * d_kurt / 4) / (n - 1)
        z = sr / math.sqrt(v)
        return z, d_sr / math.sqrt(v) - 0.5 * sr * d_v / v**1.5

    best, at = value(w)[0], w
    for i in range(steps):
        z, g = value(w)
        if z > best:
            best, at = z, w
        step = w + rate / math.sqrt(1 + i / 100) * g / max(np.abs(g).max(), 1e-300)
        lo, hi = -10.0, 10.0  # the shift that makes the clipped weights sum to 1
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(step + mid, low, high).sum() < 1 else (lo, mid)
        w = np.clip(step + (lo + hi) / 2, low, high)
    return at, float(best)
