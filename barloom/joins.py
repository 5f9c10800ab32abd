"""As-of joins, interval sweeps and range joins over series, without one task per series and without pairs that don't meet.

Times are columns of epoch microseconds (BIGINT). As-of joins and sweeps are running aggregates over the union of both sides
(barloom.ordering.running); range joins explode intervals into calendar cells and join by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.ordering import DAY_US, HOUR_US, running


def _same(keys: Sequence[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, values: Sequence[str], forward: bool = False, exact: bool = True, cell_us: int = 6 * HOUR_US) -> DataFrame:
    """All rows of ``left`` with ``values`` of the last right row at or before ``on`` (``forward``: the first at or after), null where there is
    none; ``exact=False`` leaves out equal times. Of right rows with one time the greatest values count. Left rows keep their
    columns; a null ``on`` matches nothing."""
    way = -1 if forward else 1
    first, second = (0, 1) if exact else (1, 0)
    columns = left.columns
    l = left.select(*keys, (F.col(on) * way).alias("_t"), F.lit(second).alias("_side"), F.struct(*[F.col(c) for c in columns]).alias("_left"))
    r = right.where(F.col(right_on).isNotNull()).groupBy(*keys, (F.col(right_on) * way).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    r = r.select(*keys, "_t", F.lit(first).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), "_v")
    l = l.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType))
    known, unknown = l.where(F.col("_t").isNotNull()), l.where(F.col("_t").isNull())
    seen = running(known.unionByName(r), keys, "_t", ["_side"], {"_found": ("last", "_v")}, cell_us=cell_us).where(F.col("_left").isNotNull())
    out = lambda df, found: df.select(*[F.col(f"_left.{c}") for c in columns], *[found[v].alias(v) for v in values])
    return out(seen, F.col("_found")).unionByName(out(unknown, F.col("_v")))


def sweep(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, sums: dict[str, Column], closed: bool = True, cell_us: int = 6 * HOUR_US) -> DataFrame:
    """``points`` with, for each of ``sums``, its total over the intervals that hold the point: start <= at <= end (``closed``) or
    start <= at < end. A null end never comes. n log n: +value at the start, -value after the end, running sum."""
    columns = points.columns
    ends = 2 if closed else 0
    opened = intervals.where(F.col(start).isNotNull()).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("k"), *[c.cast("double").alias(n) for n, c in sums.items()]), F.struct(F.col(end).alias("t"), F.lit(ends).alias("k"), *[(-c).cast("double").alias(n) for n, c in sums.items()]))).alias("_e"))
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.struct(*[F.col(c) for c in columns]).alias("_point"), *[F.lit(0.0).alias(f"_{n}") for n in sums])
    e = opened.where(F.col("_e.t").isNotNull()).select(*keys, F.col("_e.t").alias("_t"), F.col("_e.k").alias("_k"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), *[F.col(f"_e.{n}").alias(f"_{n}") for n in sums])
    rows = running(p.unionByName(e), keys, "_t", ["_k"], {n: ("sum", f"_{n}") for n in sums}, cell_us=cell_us)
    return rows.where(F.col("_point").isNotNull()).select(*[F.col(f"_point.{c}") for c in columns], *sums)


def interval_sums(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, sums: dict[str, Column], cell_us: int = 6 * HOUR_US) -> DataFrame:
    """The distinct (keys, start, end) of ``intervals`` with the totals of ``sums`` over the points in [start, end]: differences of running
    sums, so no interval meets its points one by one."""
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("_i"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, c in sums.items()])
    i = intervals.select(*keys, start, end).distinct()
    both = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("k")), F.struct(F.col(end).alias("t"), F.lit(2).alias("k")))).alias("_e")
    q = i.select(*keys, F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("_i"), both).select(*keys, F.col("_e.t").alias("_t"), F.col("_e.k").alias("_k"), "_i", *[F.lit(0.0).alias(f"_{n}") for n in sums])
    rows = running(p.unionByName(q), keys, "_t", ["_k"], {n: ("sum", f"_{n}") for n in sums}, cell_us=cell_us).where(F.col("_i").isNotNull())
    signed = lambda n: F.sum(F.when(F.col("_k") == 2, F.col(n)).otherwise(-F.col(n))).alias(n)
    return rows.groupBy(*keys, F.col("_i.s").alias(start), F.col("_i.e").alias(end)).agg(*[signed(n) for n in sums])


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, cell_us: int = DAY_US) -> DataFrame:
    """Every (point, interval) pair of a series with start <= at <= end: columns of both. Pairs meet only in calendar cells that both
    touch."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / cell_us), F.floor(F.col(end) / cell_us))).alias("_cell")
    i = intervals.where(F.col(end) >= F.col(start)).select("*", cells).alias("i")
    p = points.withColumn("_cell", F.floor(F.col(at) / cell_us)).alias("p")
    pairs = p.join(i, [*_same([*keys, "_cell"], "p", "i"), F.col(f"p.{at}") >= F.col(f"i.{start}"), F.col(f"p.{at}") <= F.col(f"i.{end}")])
    return pairs.select(*[F.col(f"i.{c}") for c in intervals.columns], *[F.col(f"p.{c}") for c in points.columns if c not in keys])
