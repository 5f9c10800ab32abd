"""Cleaning of series: repeats, gaps, infinities, alignment. Fills are carried over calendar cells, so no task holds a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.joins import asof_join
from barloom.ordering import HOUR_US, running


def keep_one(df: DataFrame, by: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row by ``order`` of each ``by``; a null order comes first. One aggregate with map-side combine, no window."""
    others = [c for c in df.columns if c not in by]
    pick = (F.max if last else F.min)(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(c) for c in others if "map<" not in dict(df.dtypes)[c]]))
    return df.groupBy(*by).agg(pick.alias("_r")).select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in df.columns])


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], tie: Sequence[str] = (), cell_us: int = 6 * HOUR_US) -> DataFrame:
    """Nulls take the last value before them."""
    out = running(df, keys, order, tie, {f"_f_{c}": ("last", c) for c in columns}, cell_us=cell_us)
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_backward(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], cell_us: int = 6 * HOUR_US) -> DataFrame:
    """Nulls take the next value after them; order is a whole number."""
    out = running(df.withColumn("_back", -F.col(order)), keys, "_back", [], {f"_f_{c}": ("last", c) for c in columns}, cell_us=cell_us)
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def without_infinities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinite values become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c in columns})


def zeros_to_previous(df: DataFrame, keys: Sequence[str], order: str, column: str, tie: Sequence[str] = (), cell_us: int = 6 * HOUR_US) -> DataFrame:
    """Zeros take the last value before them that isn't 0."""
    return fill_forward(df.withColumn(column, F.when(F.col(column) != 0, F.col(column))), keys, order, [column], tie, cell_us)


def align(index: DataFrame, values: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], backfill: bool = False) -> DataFrame:
    """index with the columns of ``values`` at equal times, or at the next time at or after."""
    if backfill:
        return asof_join(index, values.withColumnRenamed(on, "_at"), keys, on, "_at", columns, forward=True)
    return index.join(values.select(*keys, on, *columns), [*keys, on], "left")
