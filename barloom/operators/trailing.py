"""Totals and averages over trailing calendar periods, days without activity included.

Method: binary doubling. Sums over 1, 2, 4, 8, 16 ... days come from two shifted sums of half the length; any window is
put together from the blocks of its binary digits. All shifts share one sort of a dense daily series, whose length is
bounded by the calendar however many rows an entity has: rows are reduced to one per entity and day first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_dense(df: DataFrame, keys: Sequence[str], ts: str, version: str, values: Sequence[str], scale: dict[str, int]) -> DataFrame:
    """One row per entity and UTC day from its first to its last day: of several rows of a day the one with the highest
    ``version`` counts. ``_x_<value>`` is the value (0 if absent), ``_k_<value>`` 1 where it is present."""
    day = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")

    def exact(v: str):
        c = F.col(v).cast("double")
        c = F.when(~F.isnan(c) & (F.abs(c) < F.lit(1e300)), c)
        # Scaled to whole numbers the sums are exact and do not depend on their order.
        return (F.round(c * F.lit(float(scale[v])), 0).cast("long") if v in scale else c).alias(v)

    rows = df.where(F.col(ts).isNotNull()).select(*keys, day.alias("_d"), F.struct(F.col(version).alias("version"), *[exact(v) for v in values]).alias("_r"))
    latest = rows.groupBy(*keys, "_d").agg(F.max("_r").alias("_r"))
    nxt = F.lead("_d").over(Window.partitionBy(*keys).orderBy("_d"))
    spans = latest.select(*keys, "_d", "_r", F.coalesce(nxt - 1, F.col("_d")).alias("_to"))
    dense = spans.select(*keys, "_d", "_r", F.explode(F.sequence("_d", "_to")).alias("_day"))
    seen = F.col("_day") == F.col("_d")
    zero = lambda v: F.lit(0).cast("long") if v in scale else F.lit(0.0)
    return dense.select(
        *keys, "_day", seen.alias("_active"),
        *[F.coalesce(F.when(seen, F.col(f"_r.{v}")), zero(v)).alias(f"_x_{v}") for v in values],
        *[F.when(seen & F.col(f"_r.{v}").isNotNull(), 1).otherwise(0).alias(f"_k_{v}") for v in values],
    )


def trailing_totals(df: DataFrame, keys: Sequence[str] = ("instrument",), ts: str = "ts", version: str = "seq", values: Sequence[str] = ("Close", "Volume"), days: Sequence[int] = (7, 30), scale: dict[str, int] | None = None) -> DataFrame:
    """For every entity and calendar day: keys, ``day`` (DATE), ``active`` (the day has a row), ``history_days`` (days since the first,
    itself included), and for each value and window ``<value>_sum_<n>``, ``<value>_count_<n>`` (non-null values) and ``<value>_avg_<n>``
    (null where the count is 0). The sum runs over what history there is.

    ``scale`` names values that are whole multiples of 1 / scale; they are summed as integers, exactly.
    Rows with a null ts are ignored; null, NaN and infinite values count as absent; a null version ranks lowest; null keys form
    their own entity; of rows equal in version the greater values win. An empty table gives no rows. Other columns are ignored.
    """
    if not days or min(days) < 1:
        raise ValueError("days must be positive")
    scale = scale or {}
    state = daily_dense(df, keys, ts, version, values, scale)
    w = Window.partitionBy(*keys).orderBy("_day")
    names = [f"_{a}_{v}" for v in values for a in "xk"]
    state = state.withColumn("_h", F.row_number().over(w)).select("*", *[F.col(c).alias(f"{c}_1") for c in names])
    size = 1
    while size * 2 <= max(days):
        state = state.select("*", *[(F.col(f"{c}_{size}") + F.coalesce(F.lag(f"{c}_{size}", size).over(w), F.lit(0))).alias(f"{c}_{size * 2}") for c in names])
        size *= 2

    def window_sum(c: str, n: int):
        parts, back, bit = [], 0, size
        while bit:
            if n & bit:
                block = F.col(f"{c}_{bit}")
                parts.append(block if not back else F.coalesce(F.lag(f"{c}_{bit}", back).over(w), F.lit(0)))
                back += bit
            bit //= 2
        return sum(parts[1:], parts[0])

    state = state.select("*", *[window_sum(c, n).alias(f"{c}_t{n}") for c in names for n in days])
    out = [*keys, F.date_from_unix_date("_day").alias("day"), F.col("_active").alias("active"), F.col("_h").alias("history_days")]
    for v in values:
        unit = float(scale.get(v, 1))
        for n in days:
            x, k = F.col(f"_x_{v}_t{n}"), F.col(f"_k_{v}_t{n}")
            out += [(x / F.lit(unit)).alias(f"{v}_sum_{n}"), k.cast("long").alias(f"{v}_count_{n}"), F.when(k > 0, x / F.lit(unit) / k).alias(f"{v}_avg_{n}")]
    return state.select(*out)
