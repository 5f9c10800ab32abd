"""Linear recurrences y(t) = a(t) y(t - 1) + b(t) along a series, in blocks.

Two steps of such a recurrence are one step of the same kind, so a block of rows is scanned by doubling (numpy, log2 n passes over
whole arrays) from y = 0, its last row says how the block turns any y before it into the one behind, and these few steps are
run over the blocks. A hot series is as many tasks as it has blocks; a series within one block needs no second look.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.fold import fold, groups
from barloom.ordering import BLOCK_ROWS, HOUR_US, with_position
from barloom.shared import materialize, small_side


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps from the first row on put together, for each row."""
    a, b, shift = a.copy(), b.copy(), 1
    with np.errstate(under="ignore"):
        while shift < len(a):
            b[shift:] = a[shift:] * b[:-shift] + b[shift:]
            a[shift:] = a[shift:] * a[:-shift]
            shift *= 2
    return a, b


class _Carry:
    """The value before each block, from the blocks' steps in order."""

    def __init__(self, names: Sequence[str]) -> None:
        self.names, self.y = names, dict.fromkeys(names, 0.0)

    def feed(self, columns):
        out = {n: [] for n in self.names}
        for i in range(len(columns["_block"])):
            for n in self.names:
                self.y[n] = columns[f"_a_{n}"][i] * self.y[n] + columns[f"_b_{n}"][i]
                out[n].append(self.y[n])
        return {"_next": columns["_block"] + 1} | {n: np.array(v) for n, v in out.items()}

    def finish(self):
        return {}


def linear_scan(df: DataFrame, keys: Sequence[str], order: str, channels: dict[str, tuple[Column, Column]], tie: Sequence[str] = (), cell_us: float = 6 * HOUR_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with a column for each channel (a, b): y = a y(before) + b in the order (order, tie) of its series, 0 before the first row. a and b hold no nulls."""
    names = list(channels)
    rows = with_position(df.withColumns({f"_{k}_{n}": c.cast("double") for n, ab in channels.items() for k, c in zip("ab", ab)}), keys, order, tie, cell_us)
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / F.lit(block_rows)))
    steps = [f"_{k}_{n}" for n in names for k in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, [*keys, "_block"]):
            for n in names:
                ab = composed(*[table.column(f"_{k}_{n}").to_numpy() for k in "ab"])
                for k, x in zip("ab", ab):
                    i = table.column_names.index(f"_{k}_{n}")
                    table = table.set_column(i, table.column_names[i], pa.array(x))
            yield from table.to_batches()

    scanned = rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_pos").mapInArrow(run, rows.schema)
    plain = [F.col(c) for c in df.columns]
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).isEmpty():
        return scanned.select(*plain, *[F.col(f"_b_{n}").alias(n) for n in names])
    scanned = materialize(scanned, "scanned")
    ends = scanned.where(F.pmod("_pos", F.lit(block_rows)) == block_rows - 1)
    carry = fold(ends, keys, ["_block"], ["_block", *steps], lambda: _Carry(names), "_next bigint, " + ", ".join(f"{n} double" for n in names))
    carry = small_side(materialize(carry.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_next", *[F.col(n).alias(f"_y_{n}") for n in names]), "carry"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = scanned.join(carry, [*same, F.col("_block") == F.col("_next")], "left")
    return joined.select(*plain, *[(F.col(f"_a_{n}") * F.coalesce(f"_y_{n}", F.lit(0.0)) + F.col(f"_b_{n}")).alias(n) for n in names])
