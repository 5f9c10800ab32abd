"""Order within a series, without one task for the whole series.

A series (one instrument, say) may hold a third of all rows. ``with_position`` numbers its rows from counts by calendar
cell; ``in_blocks`` then cuts it into blocks of rows with copies of the neighbours' edge rows, so a window over
(keys, block) sees every neighbour it needs while no group grows with the data.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
BLOCK_ROWS = 50_000


def cell_keys(df: DataFrame, keys: Sequence[str], ts: str, cell_us: int) -> tuple[dict[str, Column], list[str]]:
    """Columns that name the series and calendar cell of a row without a null: windows, counts and joins by them share one shuffle and one sort, where a null-safe join
    by the keys would shuffle the rows again."""
    at = F.unix_micros(ts) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts)
    columns = {"_in_cell": F.floor(at / F.lit(cell_us))}
    for i, (k, kind) in enumerate(df.select(*keys).dtypes):
        simple = kind in ("tinyint", "smallint", "int", "bigint", "string", "boolean", "date")
        if simple:
            zero = F.lit({"string": "", "boolean": False, "date": datetime.date(1970, 1, 1)}.get(kind, 0)).cast(kind)
            columns |= {f"_in_key{i}": F.coalesce(F.col(k), zero), f"_in_null{i}": F.isnull(k)}
        else:  # a struct equals another where its fields do, nulls included
            columns |= {f"_in_key{i}": F.struct(F.col(k).alias("k"))}
    return columns, list(columns)


def earlier_cells(by: Sequence[str]):
    """The cells of a series before this one."""
    return Window.partitionBy(*by[1:]).orderBy(by[0]).rowsBetween(Window.unboundedPreceding, -1)


def with_cells(rows: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.alias("l").join(cells.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by], "inner")


def with_position(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), cell_us: int = HOUR_US * 6, out: str = "_pos") -> DataFrame:
    """Adds ``out``: the row's 0-based rank in its series by (ts, tie). ``ts`` holds no nulls.

    Rows are ranked inside (keys, calendar cell); the cells' counts, one row per cell and so bounded by the calendar, give
    the cells' offsets.
    """
    columns, by = cell_keys(df, keys, ts, cell_us)
    rows = df.withColumns(columns)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*by, F.coalesce(F.sum("_n").over(earlier_cells(by)), F.lit(0)).alias("_offset"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(ts, *tie)))
    joined = with_cells(ranked, offsets, by)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._offset") + F.col("l._rank") - 1).alias(out))


def even_cell(df: DataFrame, ts: str, rows: int = 4096) -> float:
    """A calendar cell (microseconds, or units of ``ts``) that holds about so many rows of the table: for series whose rows come much denser than others'."""
    at = F.unix_micros(ts) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts)
    low, high, n = df.agg(F.min(at), F.max(at), F.count(at)).first()
    return max((high - low) * rows / n, 1.0) if n and high > low else float(DAY_US)


def in_blocks(df: DataFrame, halo: int, pos: str = "_pos", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_block`` and ``_core``: each row stands in its own block, and as a copy (``_core`` false) in the next or previous
    block if it is within ``halo`` rows of the edge."""
    if block_rows <= 2 * halo:
        raise ValueError("block_rows must exceed twice the halo")
    own = F.floor(F.col(pos) / F.lit(block_rows))
    at = F.pmod(F.col(pos), F.lit(block_rows))
    blocks = F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= block_rows - halo, own + 1))
    out = df.withColumn("_block", F.explode(F.array_compact(blocks)))
    return out.withColumn("_core", F.col("_block") == own)


def running(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], specs: dict[str, tuple[str, Column | str]], inclusive: bool = True, cell_us: int = HOUR_US * 6) -> DataFrame:
    """Adds running aggregates along each series: ``specs`` maps an output to ('sum' | 'max' | 'min' | 'last' | 'count', column); 'last' is the last
    non-null value. They run inside (keys, calendar cell) and are carried over cells by the cells' own aggregates.
    ``inclusive=False`` ends before the row itself, so ('last', x) is the previous non-null x."""
    whole = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    inputs = {f"_in_{o}": (F.col(c) if isinstance(c, str) else c) for o, (_, c) in specs.items()}
    columns, by = cell_keys(df, keys, ts, cell_us)
    rows = df.withColumns(columns | inputs)
    here = Window.partitionBy(*by).orderBy(ts, *tie)
    frame = here.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({f"_run_{o}": whole[f](f"_in_{o}").over(frame) for o, (f, _) in specs.items()})
    order = F.struct(ts, *tie)

    def total(o: str, f: str) -> Column:
        return F.max(F.when(F.col(f"_in_{o}").isNotNull(), F.struct(order.alias("o"), F.col(f"_in_{o}").alias("v"))))["v"] if f == "last" else whole[f](f"_in_{o}")

    cells = rows.groupBy(*by).agg(*[total(o, f).alias(f"_cell_{o}") for o, (f, _) in specs.items()])
    carry = {"count": F.sum}
    cells = cells.select(*by, *[carry.get(f, whole[f])(f"_cell_{o}").over(earlier_cells(by)).alias(f"_carry_{o}") for o, (f, _) in specs.items()])
    joined = with_cells(rows, cells, by)

    def merged(o: str, f: str) -> Column:
        a, b = F.col(f"l._run_{o}"), F.col(f"r._carry_{o}")
        if f in ("sum", "count"):
            return F.coalesce(a + b, a, b)
        if f == "last":
            return F.coalesce(a, b)
        return F.greatest(a, b) if f == "max" else F.least(a, b)

    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[merged(o, f).alias(o) for o, (f, _) in specs.items()])


def blocked(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], halo: int, block_rows: int = BLOCK_ROWS, cell_us: int = HOUR_US * 6) -> DataFrame:
    """Position and blocks at once. Window functions over ``block_window(keys)`` that look no further than ``halo`` rows are exact
    on the rows with ``_core``; finish with ``core``."""
    return in_blocks(with_position(df, keys, ts, tie, cell_us), halo, block_rows=max(block_rows, 4 * halo))


def block_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_block").orderBy("_pos")


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_block", "_core", "_pos")


class Staged:
    """Columns over one window, added in stages (a window function can't hold another). All stages share one shuffle and sort."""

    def __init__(self, df: DataFrame, window, halo: int | None = None) -> None:
        self.df, self.w, self.halo = df, window, halo

    @classmethod
    def over(cls, df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), halo: int = 100, cell_us: int = HOUR_US * 6) -> "Staged":
        """Blocks with ``halo`` rows of the neighbours; end with ``rows``."""
        return cls(blocked(df, keys, ts, tie, halo, cell_us=cell_us), block_window(keys), halo)

    def _reach(self, n: int) -> None:
        if self.halo is not None and n > self.halo:
            raise ValueError(f"a reach of {n} rows needs a halo of as many, not {self.halo}")

    def let(self, **columns: Column) -> "Staged":
        if columns.keys() & {"_pos", "_block", "_core"}:
            raise ValueError("the series is ordered by that column")
        self.df = self.df.withColumns(columns)
        return self

    def lag(self, c: Column | str, n: int = 1) -> Column:
        self._reach(n)
        return F.lag(c, n).over(self.w)

    def lead(self, c: Column | str, n: int = 1) -> Column:
        self._reach(n)
        return F.lead(c, n).over(self.w)

    def diff(self, c: str) -> Column:
        return F.col(c) - self.lag(c)

    def log_return(self, c: str) -> Column:
        """Null where either value isn't positive."""
        return F.ln(F.try_divide(F.col(c), self.lag(c)))

    def change(self, c: str) -> Column:
        """Relative change; null after a 0."""
        return F.try_divide(F.col(c), self.lag(c)) - 1

    def roll(self, f, c: Column | str, n: int) -> Column:
        """``f`` of the last n values; null unless all n are there."""
        self._reach(n - 1)
        c = F.col(c) if isinstance(c, str) else c
        frame = self.w.rowsBetween(1 - n, 0)
        return F.when(F.count(c).over(frame) == n, f(c).over(frame))

    def ahead(self, f, c: Column | str, n: int) -> Column:
        """``f`` of this and the next n - 1 values; null unless all n are there."""
        self._reach(n - 1)
        c = F.col(c) if isinstance(c, str) else c
        frame = self.w.rowsBetween(0, n - 1)
        return F.when(F.count(c).over(frame) == n, f(c).over(frame))

    def rows(self, *columns: str | Column) -> DataFrame:
        return self.df.where("_core").select(*columns)
