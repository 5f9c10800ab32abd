"""Ordered folds: state machines that run once over a sorted series.

``fold`` sorts each series inside its partition and streams it in Arrow batches through one machine, so a task holds the
machine's state and one batch, never a series. A fold whose next state depends on its last can't be split along the
series; that is the one place where a hot series costs one long task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


class Machine(Protocol):
    def feed(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The next rows of the series, in order; returns the rows that they emit."""

    def finish(self) -> dict[str, np.ndarray]:
        """What the series' end emits."""


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> dict[str, np.ndarray]:
    out = {}
    for n in names:
        c = batch.column(n)
        if pa.types.is_timestamp(c.type):
            out[n] = np.asarray(c.cast(pa.timestamp("us", c.type.tz)).cast(pa.int64()))
        else:
            out[n] = c.to_numpy(zero_copy_only=False)
    return out


def starts_of(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """The rows of a batch sorted by ``keys`` at which a key begins; nulls are equal to each other."""
    codes = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
    changed = np.ones(len(codes), dtype=bool)
    if len(codes) > 1:
        a, b = codes.iloc[1:].reset_index(drop=True), codes.iloc[:-1].reset_index(drop=True)
        changed[1:] = ~((a == b) | (a.isna() & b.isna())).all(axis=1).to_numpy()
    return np.flatnonzero(changed)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The whole groups of batches sorted by ``keys``. A group is held in memory: its size must be bounded."""
    parts: list[pa.RecordBatch] = []
    key: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = starts_of(batch, keys)
        for s, e in zip(starts, np.append(starts[1:], batch.num_rows)):
            here = tuple(batch.column(k)[int(s)].as_py() for k in keys)
            if parts and here != key:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts = []
            parts.append(batch.slice(s, e - s))
            key = here
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


#: Series and values that ``fold_together`` hands over at once.
TOGETHER_SERIES, TOGETHER_VALUES = 2048, 2_000_000


def fold_together(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fn: Callable[[list[np.ndarray]], dict[str, np.ndarray]], outputs: str) -> DataFrame:
    """keys and the double ``outputs`` of fn, which gets the values of many whole series in one call, without the null ones, and returns an entry for each. A series of
    any length is held in memory."""
    rows = df.select(*keys, *order, df[value].cast("double").alias("_x")).repartition(*keys).sortWithinPartitions(*keys, *order)
    kept = df.select(*keys).schema
    names = [x.strip() for x in outputs.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{o} double" for o in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fitted() -> pa.RecordBatch:
            out = fn(series)
            columns = [pa.concat_arrays([h.column(k).combine_chunks() for h in heads]) for k in keys]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(np.asarray(out[o], dtype=float), from_pandas=True) for o in names]], names=[*keys, *names])

        series: list[np.ndarray] = []
        heads: list[pa.Table] = []
        for g in groups(batches, keys):
            x = g.column("_x").to_numpy().astype(float)
            heads.append(pa.table({k: g.column(k).slice(0, 1) for k in keys}))
            series.append(x[~np.isnan(x)])
            if len(series) >= TOGETHER_SERIES or max(map(len, series)) * len(series) >= TOGETHER_VALUES:
                yield fitted()
                series, heads = [], []
        if series:
            yield fitted()

    return rows.mapInArrow(run, schema)


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], machine: Callable[[], Machine], outputs: str) -> DataFrame:
    """keys and the machine's ``outputs`` (a DDL list; timestamps as epoch microseconds in the machine's arrays)."""
    rows = df.select(*dict.fromkeys([*keys, *order, *inputs])).repartition(*keys).sortWithinPartitions(*keys, *order)
    kept = df.select(*keys).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [outputs])
    out_names = [part.strip().split()[0].strip("`") for part in outputs.split(",")]
    out_types = [part.strip().split()[1] for part in outputs.split(",")]
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC"), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def emit(key: tuple, out: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            n = len(next(iter(out.values()))) if out else 0
            if n:
                columns = [pa.array([k] * n, t) for k, t in zip(key, key_types)]
                columns += [pa.array(out[c], from_pandas=True).cast(arrow[t]) for c, t in zip(out_names, out_types)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *out_names])

        key_types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key_types = [batch.column(k).type for k in keys]
            starts = starts_of(batch, keys)
            for s, e in zip(starts, np.append(starts[1:], batch.num_rows)):
                part = batch.slice(s, e - s)
                key = tuple(part.column(k)[0].as_py() for k in keys)
                if state is None or key != current:
                    if state is not None:
                        yield from emit(current, state.finish())
                    current, state = key, machine()
                yield from emit(key, state.feed(_columns(part, inputs)))
        if state is not None:
            yield from emit(current, state.finish())

    return rows.mapInArrow(run, schema)
