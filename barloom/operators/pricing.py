"""Option, futures and forward prices from simulated paths (path, step, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def payoff(value: Column, strike: float, kind: str) -> Column:
    if kind not in ("call", "put"):
        raise ValueError("kind is call or put")
    return F.greatest(value - strike if kind == "call" else strike - value, F.lit(0.0))


def european_payoffs(paths: DataFrame, strike: float, rate: float, maturity: float, kind: str = "call") -> DataFrame:
    """paths with ``payoff``, discounted from maturity, at every step."""
    return paths.withColumn("payoff", payoff(F.col("value"), strike, kind) * math.exp(-rate * maturity))


def _last(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path").agg(F.max_by("value", "step").alias("last"), F.min_by("value", "step").alias("first"), F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.exp(F.avg(F.ln("value"))).alias("geometric"))


def european(paths: DataFrame, strike: float, rate: float, maturity: float, kind: str = "call") -> DataFrame:
    """One row: ``price`` and its ``error`` (standard error)."""
    return _price(payoff(F.col("last"), strike, kind), _last(paths), rate, maturity)


def _price(gain: Column, ends: DataFrame, rate: float, maturity: float) -> DataFrame:
    d = math.exp(-rate * maturity)
    g = ends.select((gain * d).alias("g"))
    return g.agg(F.avg("g").alias("price"), (F.stddev_samp("g") / F.sqrt(F.count("g").cast("double"))).alias("error"))


def asian(paths: DataFrame, strike: float, rate: float, maturity: float, kind: str = "call", average: str = "arithmetic") -> DataFrame:
    """On the average over time of each path."""
    if average not in ("arithmetic", "geometric"):
        raise ValueError("average is arithmetic or geometric")
    return _price(payoff(F.col("mean" if average == "arithmetic" else "geometric"), strike, kind), _last(paths), rate, maturity)


def asian_by_step(paths: DataFrame, strike: float, rate: float, maturity: float, kind: str = "call", average: str = "arithmetic") -> DataFrame:
    """step and ``payoff`` on the average over paths at each step."""
    mean = F.avg("value") if average == "arithmetic" else F.exp(F.avg(F.ln("value")))
    return paths.groupBy("step").agg((payoff(mean, strike, kind) * math.exp(-rate * maturity)).alias("payoff"))


def lookback(paths: DataFrame, rate: float, maturity: float, kind: str = "call", strike: float | None = None) -> DataFrame:
    """Floating strike (the path's low or high) or a fixed one against the path's high or low."""
    if strike is None:
        gain = F.col("last") - F.col("low") if kind == "call" else F.col("high") - F.col("last")
    else:
        gain = payoff(F.col("high" if kind == "call" else "low"), strike, kind)
    return _price(gain, _last(paths), rate, maturity)


def barrier(paths: DataFrame, strike: float, level: float, rate: float, maturity: float, kind: str = "call", direction: str = "up", effect: str = "out", parisian: int = 1) -> DataFrame:
    """Knock-in or knock-out when the path stays beyond the level for ``parisian`` steps in a row."""
    beyond = F.col("value") >= level if direction == "up" else F.col("value") <= level
    if parisian > 1:
        w = Window.partitionBy("path").orderBy("step").rowsBetween(1 - parisian, 0)
        rows = paths.withColumn("_hit", F.sum(F.when(beyond, 1).otherwise(0)).over(w) >= parisian)
    else:
        rows = paths.withColumn("_hit", beyond)
    ends = rows.groupBy("path").agg(F.max_by("value", "step").alias("last"), F.max("_hit").alias("hit"))
    alive = F.col("hit") if effect == "in" else ~F.col("hit")
    return _price(F.when(alive, payoff(F.col("last"), strike, kind)).otherwise(F.lit(0.0)), ends, rate, maturity)


def american(paths: DataFrame, strike: float, rate: float, maturity: float, kind: str = "put", degree: int = 2, block: int = 5000) -> DataFrame:
    """Least-squares Monte Carlo with a polynomial continuation value. Paths are regressed in blocks of ``block`` paths, each in one task; the price is the mean
    over all."""
    wide = paths.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda x: x["value"]).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.to_numpy())
        steps = x.shape[1] - 1
        d = math.exp(-rate * maturity / steps)
        gain = np.maximum(x - strike if kind == "call" else strike - x, 0)
        cash = gain[:, -1].copy()
        for t in range(steps - 1, 0, -1):
            cash *= d
            money = gain[:, t] > 0
            if money.sum() > degree + 1:
                fit = np.polyval(np.polyfit(x[money, t] / strike, cash[money], degree), x[money, t] / strike)
                go = gain[money, t] > fit
                cash[np.flatnonzero(money)[go]] = gain[money, t][go]
        return pd.DataFrame({"path": pdf.path, "g": cash * d})

    g = wide.groupBy(F.floor(F.col("path") / block).alias("_b")).applyInPandas(run, "path bigint, g double")
    return g.agg(F.avg("g").alias("price"), (F.stddev_samp("g") / F.sqrt(F.count("g").cast("double"))).alias("error"))


def futures(paths: DataFrame) -> DataFrame:
    """One row: the mean price at the last step."""
    return _last(paths).agg(F.avg("last").alias("price"))


def forward(start: float, rate: float, dividend: float, maturity: float) -> float:
    return start * math.exp((rate - dividend) * maturity)


def parity_gap(call: float, put: float, start: float, strike: float, rate: float, maturity: float) -> float:
    """Call - put - (start - discounted strike): 0 for consistent prices."""
    return call - put - (start - strike * math.exp(-rate * maturity))
