"""Microstructure features: spreads, price impact, order-flow imbalance.

Rolling features take a ``Staged`` series (one shuffle, blocks of rows) and add columns to it; a value is null until its window
is full. Features of whole groups are plain aggregates with map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.special import norm_cdf, sign
from barloom.ordering import Staged

_DEN = 3 - 2 * math.sqrt(2)


def roll_measure(s: Staged, close: str = "c", window: int = 20, out: str = "roll") -> Staged:
    """Twice the root of the absolute serial covariance of price changes."""
    s.let(_dp=s.diff(close)).let(_dq=s.lag("_dp"))
    frame = s.w.rowsBetween(1 - window, 0)
    both = F.when(F.col("_dp").isNotNull() & F.col("_dq").isNotNull(), 1)
    cov = F.when(F.count(both).over(frame) == window, F.covar_samp("_dp", "_dq").over(frame))
    return s.let(**{out: 2 * F.sqrt(F.abs(cov))})


def roll_impact(s: Staged, close: str = "c", dollar_volume: str = "dollar", window: int = 20, out: str = "roll_impact") -> Staged:
    return roll_measure(s, close, window, "_roll").let(**{out: F.try_divide(F.col("_roll"), F.col(dollar_volume))})


def high_low_spread(s: Staged, high: str = "h", low: str = "l", window: int = 20) -> Staged:
    """``beta``, ``gamma``, ``alpha``, ``spread`` and ``hl_volatility`` from the highs and lows of two days."""
    s.let(_hl=F.pow(F.ln(F.try_divide(F.col(high), F.col(low))), 2), _h2=s.roll(F.max, high, 2), _l2=s.roll(F.min, low, 2)).let(_b2=s.roll(F.sum, "_hl", 2))
    s.let(beta=s.roll(F.avg, "_b2", window), gamma=F.pow(F.ln(F.try_divide("_h2", "_l2")), 2))
    raw = (math.sqrt(2) - 1) * F.sqrt("beta") / _DEN - F.sqrt(F.col("gamma") / _DEN)
    s.let(alpha=F.when(raw < 0, F.lit(0.0)).otherwise(raw))
    k2 = math.sqrt(8 / math.pi)
    vol = (2**-0.5 - 1) * F.sqrt("beta") / (k2 * _DEN) + F.sqrt(F.col("gamma") / (k2**2 * _DEN))
    return s.let(spread=2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha")), hl_volatility=F.when(vol < 0, F.lit(0.0)).otherwise(vol))


def _held_sign(s: Staged, value: str, out: str) -> None:
    """The sign of ``value``; of a zero, the sign before it. It is held inside the block's halo."""
    s.let(_sg=F.when(F.col(value) > 0, 1.0).when(F.col(value) < 0, -1.0))
    s.let(**{out: F.last("_sg", ignorenulls=True).over(s.w.rowsBetween(-200, 0))})


def bar_lambdas(s: Staged, close: str = "c", volume: str = "v", dollar_volume: str = "dollar", window: int = 20) -> Staged:
    """``kyle``, ``amihud`` and ``hasbrouck``: rolling means of price change per signed volume, |log return| per dollar and log
    return per signed root dollar. A zero change keeps the last sign (of up to 200 bars)."""
    s.let(_dc=s.diff(close), _lr=s.log_return(close))
    _held_sign(s, "_dc", "_sd")
    _held_sign(s, "_lr", "_sr")
    s.let(_k=F.try_divide(F.col("_dc"), F.col(volume) * F.col("_sd")), _a=F.try_divide(F.abs("_lr"), F.col(dollar_volume)), _hb=F.try_divide(F.col("_lr"), F.col("_sr") * F.sqrt(dollar_volume)))
    return s.let(kyle=s.roll(F.avg, "_k", window), amihud=s.roll(F.avg, "_a", window), hasbrouck=s.roll(F.avg, "_hb", window))


def slope_through_origin(x: Column, y: Column) -> Column:
    """Over the rows that have both."""
    return F.try_divide(F.sum(x * y), F.sum(F.when(y.isNotNull(), x * x)))


def trade_lambdas(trades: DataFrame, keys: Sequence[str], price_diff: str = "price_diff", log_ret: str = "log_ret", volume: str = "volume", dollar: str = "dollar", flag: str = "sign") -> DataFrame:
    """``kyle``, ``amihud`` and ``hasbrouck`` per group: slopes through the origin of the trades' price change on signed volume and of
    |log return| on dollar volume and on its signed root."""
    c = F.col
    return trades.groupBy(*keys).agg(
        slope_through_origin(c(volume) * c(flag), c(price_diff)).alias("kyle"),
        slope_through_origin(c(dollar), F.abs(log_ret)).alias("amihud"),
        slope_through_origin(F.sqrt(dollar) * c(flag), F.abs(log_ret)).alias("hasbrouck"),
    )


def vpin(s: Staged, volume: str = "v", buy_volume: str = "buy", window: int = 1, out: str = "vpin") -> Staged:
    s.let(_imb=F.abs(2 * F.col(buy_volume) - F.col(volume)))
    return s.let(**{out: F.try_divide(s.roll(F.avg, "_imb", window), F.col(volume))})


def bulk_buy_volume(s: Staged, close: str = "c", volume: str = "v", window: int = 20, out: str = "buy_volume") -> Staged:
    """Volume x the normal probability of the price change in units of its rolling standard deviation."""
    s.let(_dc=s.diff(close)).let(_sd=s.roll(F.stddev_samp, "_dc", window))
    return s.let(**{out: F.col(volume) * norm_cdf(F.try_divide(F.col("_dc"), F.col("_sd")))})


def market_depth(book: DataFrame, keys: Sequence[str], bid: str, ask: str, seconds: int, ts: str = "ts", side: str = "side", volume: str = "volume") -> DataFrame:
    """Bid and ask volume per bucket of ``seconds``."""
    bucket = (F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds).alias("bucket")
    part = lambda which: F.coalesce(F.sum(F.when(F.col(side) == which, F.col(volume))), F.lit(0.0))
    return book.groupBy(*keys, bucket).agg(part(bid).alias("bid_depth"), part(ask).alias("ask_depth"))


def daily_depth(high: Column, low: Column, volume: Column) -> Column:
    return F.try_divide(volume, high - low)


def average_tick_size(volume: Column) -> Column:
    return F.avg(volume)


def vwap(dollar: Column, volume: Column) -> Column:
    return F.try_divide(F.sum(dollar), F.sum(volume))


def signed_volume(volume: Column, move: Column) -> Column:
    return volume * sign(move)
