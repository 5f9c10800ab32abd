"""A function mapped over the parts of an index, as Spark tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.ordering import with_position


def linear_bounds(n: int, parts: int) -> list[int]:
    """Bounds of at most ``parts`` parts of n items, as equal as can be."""
    k = max(1, min(parts, n))
    return [-(-i * n // k) for i in range(k + 1)]


def nested_bounds(n: int, parts: int, upper: bool = False) -> list[int]:
    """Bounds of parts of equal work where item i takes work i + 1 (``upper``: n - i), as in two nested loops."""
    k, at = max(1, min(parts, n)), [0]
    for i in range(1, k + 1):
        at.append(min(n, max(at[-1], round((math.sqrt(1 + 4 * (i * n * (n + 1) / k)) - 1) / 2))))
    at[-1] = n
    return [n - x for x in reversed(at)] if upper else at


def map_index(df: DataFrame, order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int, nested: bool = False, upper: bool = False) -> DataFrame:
    """``fn`` of each part of the rows in order, put together. Parts are ranges of positions, equal in rows or, if ``nested``, in rows times place; each is one
    group, so their number must grow with the rows. The first order column is a timestamp or number without nulls; an empty table calls nothing."""
    rows = with_position(df.withColumn("_all", F.lit(0)), ["_all"], order[0], list(order[1:])).drop("_all")
    n = df.count()
    bounds = nested_bounds(n, parts, upper) if nested else linear_bounds(n, parts)
    at = F.lit(0)
    for b in bounds[1:-1]:
        at = at + F.when(F.col("_pos") >= b, 1).otherwise(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("_pos").drop(columns=["_pos", "_part"]).reset_index(drop=True))

    return rows.withColumn("_part", at).groupBy("_part").applyInPandas(run, schema)
