"""Overlapping and gapped intervals into continuous periods and the gaps between them.

Method: sort by start per entity, compare each start with the running maximum of the previous ends, label islands by a
cumulative count, aggregate. The running maximum and the count run inside (entity, calendar cell of the start); the
cells' maxima and counts, one row per cell and so bounded by the calendar, are carried from cell to cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.ordering import DAY_US, cell_keys, earlier_cells, with_cells
from barloom.shared import materialize


def merge_intervals(df: DataFrame, keys: Sequence[str] = ("instrument",), start: str = "t0", end: str = "t1", cell_us: int = DAY_US) -> DataFrame:
    """Continuous periods: keys, ``period`` (0-based by start), ``period_start``, ``period_end``, ``n_intervals`` (rows merged,
    repeats included) and ``previous_end`` (end of the period before; null for the first).

    Intervals that share an end point belong together; start = end is valid. Rows with a null start or end, or that end
    before they start, are ignored; null keys form their own entity; repeats and ties merge. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = df.where((F.col(end) >= F.col(start))).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    # Equal starts become one row before any window, so a pile of copies is combined on the map side.
    rows = rows.groupBy(*keys, "_s").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
    # All that follows goes by these columns: windows, the cells' totals and the joins with what they carry share one partitioning.
    columns, by = cell_keys(rows, keys, "_s", cell_us)
    w = Window.partitionBy(*by).orderBy("_s")
    # Sorted once and written: both carries and the labels start from here.
    rows = materialize(rows.withColumns(columns).withColumn("_m", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))), "starts")

    def carried(rows: DataFrame, cells: DataFrame, value: Column, name: str) -> DataFrame:
        """``rows`` with ``value`` over all earlier cells of their entity."""
        return with_cells(rows, cells.select(*by, value.over(earlier_cells(by)).alias(name)), by).select("l.*", f"r.{name}")

    rows = carried(rows, rows.groupBy(*by).agg(F.max("_e").alias("_top")), F.max("_top"), "_above")
    rows = rows.withColumn("_previous", F.greatest("_m", "_above"))
    rows = rows.withColumn("_new", F.when(F.col("_previous").isNull() | (F.col("_s") > F.col("_previous")), 1).otherwise(0))
    news = rows.groupBy(*by).agg(F.sum("_new").alias("_news"))
    rows = rows.withColumn("_label", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = carried(rows, news, F.sum("_news"), "_earlier")
    period = F.col("_label") + F.coalesce(F.col("_earlier"), F.lit(0)) - 1
    return rows.groupBy(*keys, period.alias("period")).agg(
        F.min("_s").alias("period_start"), F.max("_e").alias("period_end"), F.sum("_n").alias("n_intervals"),
        F.max(F.when(F.col("_new") == 1, F.col("_previous"))).alias("previous_end"),
    )


def interval_gaps(periods: DataFrame, keys: Sequence[str] = ("instrument",), max_days: float | None = None) -> DataFrame:
    """The gaps between consecutive periods of ``merge_intervals``: keys, ``gap_start``, ``gap_end``; with ``max_days`` only
    those no longer than that."""
    gaps = periods.where(F.col("previous_end").isNotNull()).select(*keys, F.col("previous_end").alias("gap_start"), F.col("period_start").alias("gap_end"))
    if max_days is None:
        return gaps
    return gaps.where(F.unix_micros("gap_end") - F.unix_micros("gap_start") <= F.lit(int(max_days * DAY_US)))
