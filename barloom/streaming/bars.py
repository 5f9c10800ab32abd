"""The ordered folds and time bars over Structured Streaming sources.

Folds keep one pickled machine per series in the state store; the machine is the one of the batch operators. Within a micro-batch a
series' rows are sorted by (ts, seq); rows before what a series has already folded, by ts and then seq, are late: they are dropped and counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.fold import Machine
from barloom.operators.bars import BAR_COLUMNS, TRACE_COLUMNS, Expectation, ImbalanceBars, RunBars, ThresholdBars
from barloom.operators.signals import CusumMachine, DynamicZMachine


def stream_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], machine: Callable[[], Machine], outputs: str) -> DataFrame:
    """keys, the machine's ``outputs`` and ``late`` (rows of the series dropped so far) as an append stream. The first column of ``order`` is a timestamp, a second one a
    whole number; equal rows are not late."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*keys).schema)
    names = [part.strip().split()[0] for part in outputs.split(",")]
    moments = {part.strip().split()[0] for part in outputs.split(",") if part.strip().split()[1] == "timestamp"}
    ts = order[0]

    def micros(s: pd.Series) -> np.ndarray:
        return s.astype("datetime64[us]").astype("int64").to_numpy() if pd.api.types.is_datetime64_any_dtype(s) else s.to_numpy()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, late, last, tie = state.get if state.exists else (None, 0, -(1 << 62), -(1 << 62))
        m = pickle.loads(blob) if blob is not None else machine()
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        at = micros(rows[ts].dt.tz_localize(None) if getattr(rows[ts].dt, "tz", None) is not None else rows[ts])
        ties = rows[order[1]].to_numpy("int64") if len(order) > 1 else np.full(len(rows), tie)
        fresh = (at > last) | ((at == last) & (ties >= tie))
        late += int((~fresh).sum())
        rows, at, ties = rows[fresh], at[fresh], ties[fresh]
        out = m.feed({c: at if c == ts else micros(rows[c]) for c in inputs}) if len(rows) else {}
        state.update((pickle.dumps(m), late, *((int(at[-1]), int(ties[-1])) if len(at) else (last, tie))))
        n = len(next(iter(out.values()))) if out else 0
        if n:
            pdf = pd.DataFrame({c: pd.to_datetime(out[c], unit="us", utc=True).tz_localize(None) if c in moments else out[c] for c in names})
            for k, v in zip(reversed(keys), reversed(key)):
                pdf.insert(0, k, v)
            pdf["late"] = late
            yield pdf

    used = list(dict.fromkeys([*keys, *order, *inputs]))
    return stream.select(*used).groupBy(*keys).applyInPandasWithState(step, f"{kept}, {outputs}, late bigint", "machine binary, late bigint, last bigint, tie bigint", "append", GroupStateTimeout.NoTimeout)


def stream_bars(ticks: DataFrame, keys: Sequence[str], machine: Callable[[], Machine]) -> DataFrame:
    return stream_fold(ticks, keys, ["ts", "seq"], ["ts", "price", "volume"], machine, f"{BAR_COLUMNS}, {TRACE_COLUMNS}")


def stream_threshold_bars(ticks: DataFrame, keys: Sequence[str], metric: str, threshold: float) -> DataFrame:
    return stream_bars(ticks, keys, lambda: ThresholdBars(metric, threshold))


def stream_imbalance_bars(ticks: DataFrame, keys: Sequence[str], metric: str, expectation: Expectation) -> DataFrame:
    return stream_bars(ticks, keys, lambda: ImbalanceBars(metric, expectation))


def stream_run_bars(ticks: DataFrame, keys: Sequence[str], metric: str, expectation: Expectation) -> DataFrame:
    return stream_bars(ticks, keys, lambda: RunBars(metric, expectation))


def stream_cusum(values: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    s = values.select(*keys, F.col("ts").alias("_ts"), F.col(value).cast("double").alias("_x"))
    return stream_fold(s, keys, ["_ts"], ["_ts", "_x"], lambda: CusumMachine(threshold), "_ts timestamp, direction int")


def stream_dynamic_z(values: DataFrame, keys: Sequence[str], value: str, lag: int, threshold: float, influence: float) -> DataFrame:
    s = values.select(*keys, F.col("ts").alias("_ts"), F.col(value).cast("double").alias("_x"))
    return stream_fold(s, keys, ["_ts"], ["_ts", "_x"], lambda: DynamicZMachine(lag, threshold, influence), "_ts timestamp, signal int")


def stream_time_bars(ticks: DataFrame, keys: Sequence[str], seconds: int, lateness: str = "1 minute") -> DataFrame:
    """Open, high, low, close, volume, ticks and dollar value per bucket, emitted once the watermark has passed its end. Later ticks are dropped."""
    w = F.window("ts", f"{seconds} seconds")
    order = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", lateness).groupBy(*keys, w).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("cum_ticks"), F.sum(F.col("price") * F.col("volume")).alias("cum_dollar_value"),
    )
    return out.select(*keys, F.col("window.end").alias("date_time"), *out.columns[len(keys) + 1 :])


def replay(df: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, name: str, parts: int = 3, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Write ``df`` as ``parts`` files cut by time, stream them through ``build`` one file per micro-batch into a table, and return that: batch data
    through the streaming path. ``folder`` is the shared folder."""
    spark = df.sparkSession
    bounds = df.select(F.percentile_approx(F.unix_micros(order[0]), [i / parts for i in range(1, parts)])).first()[0] if parts > 1 else []
    part = sum([F.when(F.unix_micros(order[0]) > b, 1).otherwise(0) for b in bounds], F.lit(0))
    for i in range(parts):
        df.withColumn("_part", part).where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/{name}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}/in")
    q = build(stream).writeStream.format("parquet").option("path", f"{folder}/{name}/out").option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}/out")
