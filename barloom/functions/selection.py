"""Exact order statistics (medians, quantiles) per group by bin refinement.

Groups are reduced to counts of (group, bin): first logarithmic bins, then linear sub-bins of the bin that holds a
wanted rank, until that bin holds one value. Every pass is a map-side combined count, and the number of bins of a group
is bounded by the range of doubles, so a group that holds a third of all rows costs no task more than another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.shared import materialize, small_side


def log_bin(x: Column, per_octave: int) -> Column:
    """A whole number that doesn't fall as x rises; 0 for 0."""
    size = F.floor(F.log2(F.abs(x)) * F.lit(float(per_octave))) + F.lit(1100 * per_octave)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def _same(keys: Sequence[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], per_octave: int = 64, parts: int = 1024) -> DataFrame:
    """keys, ``which``, ``value`` and ``n``: for the i-th probability q the values at the ranks around q (n - 1), which = 2 i the lower and 2 i + 1 the upper
    one (the same if q falls on a rank), over the non-null, non-NaN values. Groups without such a value have no row; null keys form their own group."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_x"))
    bins = rows.groupBy(*keys, log_bin(F.col("_x"), per_octave).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    running = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    ranks = [F.struct(F.lit(2 * i + k).alias("which"), (f(place(q) + F.lit(e)) + 1).alias("rank")) for i, q in enumerate(probabilities) for k, (f, e) in enumerate(((F.floor, 1e-9), (F.ceil, -1e-9)))]
    cut = bins.withColumn("_end", running).withColumn("_total", total).withColumn("_r", F.explode(F.array(*ranks)))
    within = (F.col("_r.rank") <= F.col("_end")) & (F.col("_r.rank") > F.col("_end") - F.col("_n"))
    cut = cut.where(within).select(*keys, "_total", F.col("_r.which").alias("_which"), (F.col("_r.rank") - F.col("_end") + F.col("_n")).alias("_rank"), "_lo", "_hi")
    cut = materialize(cut, "ranks")
    done = []
    while True:
        done.append(cut.where(F.col("_lo") == F.col("_hi")))
        open_ = cut.where(F.col("_lo") < F.col("_hi"))
        if open_.isEmpty():
            break
        t, r = small_side(open_).alias("t"), rows.alias("r")
        inside = r.join(t, [*_same(keys, "r", "t"), F.col("r._x").between(F.col("t._lo"), F.col("t._hi"))]).select("t.*", "r._x")
        x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
        near = F.abs(hi) < F.lit(1e307)  # a difference of huge values overflows, of tiny ones it doesn't vanish
        share = F.when(near & (F.abs(lo) < F.lit(1e307)), (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
        part = F.floor(share * F.lit(float(parts)))
        by = [*keys, "_which"]
        sub = inside.groupBy(*by, "_total", "_rank", part.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        sub = sub.withColumn("_end", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        sub = sub.where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_n")))
        cut = materialize(sub.select(*keys, "_total", "_which", (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_rank"), "_lo", "_hi"), "ranks")
    found = reduce(DataFrame.unionByName, done)
    return found.select(*keys, F.col("_which").alias("which"), F.col("_lo").alias("value"), F.col("_total").alias("n"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, per_octave: int = 64, parts: int = 1024) -> DataFrame:
    """keys, ``median`` (mean of the middle two for an even count) and ``n``; see ``order_statistics``."""
    both = order_statistics(df, keys, value, [0.5], per_octave, parts).groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max("n").alias("n"))
    lo, hi = F.col("_lo"), F.col("_hi")
    middle = F.when(lo == hi, lo).when(F.greatest(F.abs(lo), F.abs(hi)) < F.lit(8e307), (lo + hi) / 2).otherwise(lo / 2 + hi / 2)
    return both.select(*keys, middle.alias("median"), "n")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], higher: bool = False) -> DataFrame:
    """keys, ``i`` (place of the probability), ``value`` (linear between the neighbouring ranks, or the ``higher`` one) and ``n``."""
    i = F.floor(F.col("which") / 2).cast("int")
    both = order_statistics(df, keys, value, probabilities).groupBy(*keys, i.alias("i")).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max("n").alias("n"))
    place = F.get(F.array(*[F.lit(float(q)) for q in probabilities]), F.col("i")) * (F.col("n") - 1)
    share = F.when(F.col("_hi") > F.col("_lo"), place - F.floor(place)).otherwise(F.lit(0.0))
    return both.select(*keys, "i", (F.col("_hi") if higher else F.col("_lo") + share * (F.col("_hi") - F.col("_lo"))).alias("value"), "n")


def quantile_list(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float]:
    """The quantiles of a whole column, linear between ranks; empty for an empty column."""
    return [float(r.value) for r in exact_quantiles(df, [], value, probabilities).orderBy("i").collect()]
