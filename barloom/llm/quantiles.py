"""Percentiles of very large numeric columns, per group, from summaries that combine.

Method: cumulative frequencies. Rows become counts of (group, value), with map-side combine; the counts are sorted by range
over all partitions; each partition's sums give the offset of the next, window sums run inside (partition, group), and
the first value whose cumulative count reaches a target rank is the percentile. A group that spans many partitions is
summed by as many tasks, and only the partitions that hold a target rank are summed row by row.

The summary of counts is the form in which results of files or days combine: add the counts of equal values. It is exact,
or with ``resolution`` rounded down to multiples of it: then no percentile is off by more than that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.shared import materialize, small_side


def summarize(df: DataFrame, keys: Sequence[str], fields: dict[str, tuple[float, float] | None], resolution: float | None = None) -> DataFrame:
    """keys, ``field``, ``value``, ``n``: how often each value of each field occurs in each group.

    ``fields`` gives for each column the closed range in which values count, or None for all finite ones. Null and NaN never
    count, nor do values outside the range; null keys form their own group; -0.0 is 0.0. Groups without a counted value
    have no row, an empty table gives none. Other columns are ignored.
    """

    def counted(c: str, span: tuple[float, float] | None) -> Column:
        x = F.col(c).cast("double")
        lo, hi = span or (-1.7976931348623157e308, 1.7976931348623157e308)
        x = F.when(~F.isnan(x) & x.between(lo, hi), x + F.lit(0.0))
        return F.floor(x / F.lit(resolution)) * F.lit(resolution) if resolution else x

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), counted(c, s).alias("value")) for c, s in fields.items()])).alias("_p")
    rows = df.select(*keys, pairs).where(F.col("_p.value").isNotNull())
    return rows.groupBy(*keys, F.col("_p.field").alias("field"), F.col("_p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def combine(*summaries: DataFrame) -> DataFrame:
    """The summary of all rows behind the given summaries."""
    rows = reduce(DataFrame.unionByName, summaries)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, keys: Sequence[str], probabilities: Sequence[float], partitions: int | None = None) -> DataFrame:
    """keys, ``field``, ``probability``, ``value`` and ``total``: the least value with at least ceil(probability x total) values
    at or below it (probability 0: the least value)."""
    if any(not 0 <= q <= 1 for q in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    by = [*keys, "field"]
    n = partitions or int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that the number of a row's partition is one fact and not evaluated twice.
    ranged = summary.repartitionByRange(n, *by, "value").select(*by, "value", "n", F.spark_partition_id().alias("_part"))
    ranged = materialize(ranged, "ranged")
    parts = ranged.groupBy(*by, "_part").agg(F.sum("n").alias("_sum"))
    w = Window.partitionBy(*by)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_sum").over(w))
    rank = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("_total") - F.lit(1e-9)), F.lit(1))
    targets = F.array_compact(F.array(*[F.when((rank(q) > F.col("_offset")) & (rank(q) <= F.col("_offset") + F.col("_sum")), F.struct(F.lit(float(q)).alias("q"), rank(q).alias("rank"))) for q in probabilities]))
    # A row per group, and per further partition that holds one of its targets.
    parts = small_side(materialize(parts.withColumn("_targets", targets).where(F.size("_targets") > 0), "parts"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*by, "_part"]]
    rows = ranged.alias("r").join(parts.alias("p"), same).select("r.*", "p._offset", "p._total", "p._targets")
    ends = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_end", F.col("_offset") + ends).select("*", F.explode("_targets").alias("_t"))
    rows = rows.where((F.col("_t.rank") <= F.col("_end")) & (F.col("_t.rank") > F.col("_end") - F.col("n")))
    return rows.select(*by, F.col("_t.q").alias("probability"), "value", F.col("_total").alias("total"))
