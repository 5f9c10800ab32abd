"""Messages and their entropy. A message is a string of letters of one bar or window; entropies of whole messages are Arrow UDFs, counts of
letters and words stay in SQL (``shannon_by_group``)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.selection import quantile_list
from barloom.ordering import Staged


def shannon(message: str) -> float:
    n = len(message)
    return -sum(c / n * math.log2(c / n) for c in Counter(message).values()) if n else float("nan")


def word_shares(message: str, length: int) -> dict[str, float]:
    """Shares of the words of a length; the last word doesn't count."""
    n = len(message) - length
    return {w: c / n for w, c in Counter(message[i : i + length] for i in range(n)).items()} if n > 0 else {}


def plug_in(message: str, length: int = 1) -> float:
    return -sum(p * math.log2(p) for p in word_shares(message, length).values()) / length + 0.0


def lempel_ziv(message: str) -> float:
    """Words of the growing library over the message's length."""
    if not message:
        return float("nan")
    known, i, n = {message[0]}, 1, len(message)
    while i < n:
        j = i + 1
        while j <= n and message[i:j] in known:
            j += 1
        if j <= n:
            known.add(message[i:j])
        i = j
    return len(known) / n


def match_length(message: str, at: int, window: int) -> int:
    """1 + the longest prefix of the rest, at most ``window``, that also begins in the ``window`` letters before ``at``."""
    best = 0
    while best < window and at + best + 1 <= len(message) and message.find(message[at : at + best + 1], at - window, at + best) >= 0:
        best += 1
    return best + 1


def kontoyiannis(message: str, window: int = 0) -> float:
    """Mean of log2(n + 1) / match length, over an expanding (window 0) or rolling past."""
    half = len(message) // 2
    if window <= 0:
        terms = [math.log2(i + 1) / match_length(message, i, i) for i in range(1, half + 1)]
    else:
        w = min(window, half)
        terms = [math.log2(w + 1) / match_length(message, i, w) for i in range(w, len(message) - w + 1)] if w else []
    return sum(terms) / len(terms) if terms else 0.0


MEASURES = {"shannon": shannon, "plug_in": plug_in, "lempel_ziv": lempel_ziv, "kontoyiannis": kontoyiannis}


def entropy(message: Column, measure: str) -> Column:
    """One of ``MEASURES`` of a message column; null for null."""
    fn = MEASURES[measure]

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda m: fn(m) if m is not None else None).astype("float64")

    return apply(message)


def shannon_by_group(letters: DataFrame, keys: Sequence[str], letter: str) -> DataFrame:
    """keys and ``shannon`` of the letters of each group, from their counts."""
    counts = letters.where(F.col(letter).isNotNull()).groupBy(*keys, letter).agg(F.count(F.lit(1)).alias("_n"))
    # sum(n log n) and sum(n) are enough: H = log N - sum(n log n) / N.
    out = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.log2("_n")).alias("_w"))
    return out.select(*keys, (F.log2("_all") - F.col("_w") / F.col("_all")).alias("shannon"))


def tick_letter(sign: Column) -> Column:
    return F.when(sign == 1, "a").when(sign == -1, "b").when(sign == 0, "c")


def message(order: Sequence[str | Column], letter: Column) -> Column:
    """The letters of a group, in order, as one string (an aggregate)."""
    return F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(*order, letter.alias("_letter")))), lambda x: x["_letter"]))


def quantile_keys(values: DataFrame, value: str, letters: int = 26) -> list[float]:
    """The quantiles at ``letters`` levels from 0.01 to 1; key i stands for letter i."""
    levels = [float(q) for q in np.linspace(0.01, 1, letters)]
    return quantile_list(values, value, levels)


def sigma_keys(values: DataFrame, value: str, step: float = 0.01) -> list[float]:
    """Keys from the least value to the greatest by ``step``; more than 256 are refused."""
    lo, hi = values.agg(F.min(value), F.max(value)).first()
    keys = [float(x) for x in np.arange(lo, hi, step)]
    if len(keys) > 256:
        raise ValueError(f"{len(keys)} steps exceed 256 letters")
    return keys


def nearest_letter(value: Column, keys: Sequence[float]) -> Column:
    """The letter (character i, counted from 0) of the nearest key, the first on ties."""
    codes = F.array(*[F.struct(F.abs(value - F.lit(float(k))).alias("d"), F.lit(i).alias("i")) for i, k in enumerate(dict.fromkeys(keys))])
    return F.when(value.isNotNull(), F.char(F.array_min(codes)["i"]))


def univariate_bins(n: int) -> int:
    z = (8 + 324 * n + 12 * math.sqrt(36 * n + 729 * n**2)) ** (1 / 3)
    return int(round(z / 6 + 2 / (3 * z) + 1 / 3))


def histogram_entropy(values: Column, bins: int) -> Column:
    """Entropy in nats of an array's histogram over equal bins from its least to its greatest value."""

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) == 0:
                return None
            p = np.histogram(np.asarray(x, dtype=float), bins)[0]
            p = p[p > 0] / p.sum()
            return float(-(p * np.log(p)).sum())

        return s.map(one).astype("float64")

    return apply(values)


def decile_entropy(rows: DataFrame, keys: Sequence[str], order: str, value: str, quantiles: DataFrame, window: int = 10, measure: str = "kontoyiannis") -> DataFrame:
    """keys, order and ``entropy`` of the message of the last ``window`` values, each written as the digit of its bin between the series' ``quantiles`` (keys, i, value as
    ``exact_quantiles`` gives them); null until the window has come. Nulls are left out."""
    edges = quantiles.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_edges"))
    r, e = rows.where(F.col(value).isNotNull()).select(*keys, order, value).alias("r"), edges.alias("e")
    both = r.join(e, [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]).select("r.*", F.size(F.filter("e._edges", lambda x: x < F.col(value))).cast("string").alias("_digit"))
    s = Staged.over(both, keys, order, halo=window)
    frame = s.w.rowsBetween(1 - window, 0)
    s.let(_m=F.when(F.count("_digit").over(frame) == window, F.array_join(F.collect_list("_digit").over(frame), "")))
    return s.rows(*keys, order, entropy(F.col("_m"), measure).alias("entropy")).withColumn("entropy", F.when(~F.isnan("entropy"), F.col("entropy")))
