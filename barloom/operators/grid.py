"""Irregular readings onto a regular grid.

Method: harmonic seasonal regression with a linear trend, fitted per series by distributed normal equations (one
aggregate of cross products with map-side combine, so a hot series is summed by many tasks); missing slots get the
model's value plus the residuals of the two observed endpoints, bridged linearly.

Plan: readings -> (keys, day, slot) aggregate -> window over (keys, day), at most 86400 / step slots in a group ->
explode the span to the next observed slot. No group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _design(slot: Column, per_day: int, harmonics: int) -> list[Column]:
    """1, time in days, and cosine and sine of each harmonic of the day."""
    phase = F.pmod(slot, F.lit(per_day)) * F.lit(2 * math.pi / per_day)
    waves = [f(phase * F.lit(k)) for k in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    return [F.lit(1.0), slot / F.lit(float(per_day)), *waves]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _cross_products(obs: DataFrame, keys: Sequence[str], values: Sequence[str], per_day: int, harmonics: int) -> DataFrame:
    """Per series and value, the upper triangle of X'X and X'y as one array."""
    x = _design(F.col("_slot"), per_day, harmonics)
    sums = []
    for v in values:
        ok, y = _finite(F.col(v)), F.col(v)
        terms = [a * b for i, a in enumerate(x) for b in x[i:]] + [a * y for a in x]
        sums.append(F.array(*[F.coalesce(F.sum(F.when(ok, t)), F.lit(0.0)) for t in terms]).alias(f"_s_{v}"))
    return obs.groupBy(*keys).agg(*sums)


def _solver(keys: Sequence[str], values: Sequence[str], per_day: int, harmonics: int):
    """Per series and value one array: intercept, slope a day, and the seasonal part of each slot of the day, so that a prediction is two look-ups."""
    p = 2 + 2 * harmonics
    upper = np.triu_indices(p)
    products = len(upper[0])
    phase = np.arange(per_day) * (2 * math.pi / per_day)
    waves = np.array([f(k * phase) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)]).reshape(p - 2, per_day)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            for v in values:
                s = np.asarray(batch.column(f"_s_{v}").flatten()).reshape(batch.num_rows, products + p)
                xx = np.zeros((len(s), p, p))
                xx[:, upper[0], upper[1]] = s[:, :products]
                xx[:, upper[1], upper[0]] = s[:, :products]
                xy, n = s[:, products:], np.maximum(xx[:, 0, 0], 1.0)
                # Centred, so that a trend far from the origin costs no digits; a small ridge keeps short series solvable.
                mean, mean_y = xx[:, 0, 1:] / n[:, None], xy[:, 0] / n
                c = xx[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
                r = xy[:, 1:] - n[:, None] * mean * mean_y[:, None]
                c += np.eye(p - 1) * (1e-9 * np.abs(np.trace(c, axis1=1, axis2=2))[:, None, None] + 1e-6)
                slope = np.linalg.solve(c, r[:, :, None])[:, :, 0]
                beta = np.concatenate([(mean_y - (slope * mean).sum(axis=1))[:, None], slope], axis=1)
                beta = np.where(np.isfinite(beta).all(axis=1)[:, None], beta, 0.0)
                model = np.concatenate([beta[:, :2], beta[:, 2:] @ waves], axis=1)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * model.shape[1], pa.int32()), pa.array(model.ravel())))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[f"_b_{v}" for v in values]])

    return solve


def regular_grid(df: DataFrame, keys: Sequence[str] = ("instrument",), ts: str = "date_time", tie: str = "seq", last: Sequence[str] = ("close",), total: Sequence[str] = ("volume",), step_seconds: int = 1800, harmonics: int = 2) -> DataFrame:
    """One row per series, UTC day and slot from the day's first to its last observed slot.

    Columns: keys, ``slot_start`` (epoch seconds), then for each value its observation (null where the slot has none),
    ``<value>_filled`` and ``<value>_source``: 'observed', 'modelled' (the slot lies between two observations of that
    value on the day) or 'open' (an endpoint is missing; filled is null).

    A slot's observation is the last non-null reading by (ts, tie) for ``last``, the sum of the non-null readings for ``total``.
    Rows with a null ts are ignored; null keys form their own series; a NaN or infinite reading is an observation but takes
    no part in the fit and counts as residual 0 at an endpoint; repeated rows change only totals. A value named in both
    lists, or a step that doesn't divide the day, is refused. An empty table gives no rows. Other columns are ignored.
    """
    values = [*last, *total]
    if len(set(values)) != len(values) or 86400 % step_seconds:
        raise ValueError("values must differ and the step must divide the day")
    per_day = 86400 // step_seconds
    slot = F.floor(F.unix_micros(ts) / F.lit(step_seconds * 1_000_000))
    order = F.struct(F.col(ts), F.col(tie))
    base = df.where(F.col(ts).isNotNull()).select(*keys, slot.alias("_slot"), F.floor(slot / F.lit(per_day)).alias("_day"), order.alias("_o"), *[F.col(v).cast("double").alias(v) for v in values])
    obs = base.groupBy(*keys, "_day", "_slot").agg(
        *[F.max(F.when(F.col(v).isNotNull(), F.struct("_o", F.col(v).alias("v"))))["v"].alias(v) for v in last],
        *[F.sum(v).alias(v) for v in total],
    )
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in obs.select(*keys).schema] + [f"_b_{v} array<double>" for v in values])
    model = _cross_products(obs, keys, values, per_day, harmonics).mapInArrow(_solver(keys, values, per_day, harmonics), schema)

    w = Window.partitionBy(*keys, "_day").orderBy("_slot")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, as a running frame: a frame to the end would be walked again for every row.
    after = Window.partitionBy(*keys, "_day").orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col("_slot").alias("s"), F.col(v).alias("v")))
    spans = obs.select(
        *keys, "_slot", *values, F.coalesce(F.lead("_slot").over(w) - 1, F.col("_slot")).alias("_to"),
        *[F.last(ends(v), ignorenulls=True).over(until).alias(f"_p_{v}") for v in values],
        *[F.last(ends(v), ignorenulls=True).over(after).alias(f"_q_{v}") for v in values],
    )
    s, m = spans.alias("s"), model.alias("m")
    joined = s.join(m, [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    rows = joined.select(*[F.col(f"s.{c}") for c in spans.columns], *[F.col(f"m._b_{v}") for v in values])

    def predicted(v: str, at: Column) -> Column:
        b = F.col(f"_b_{v}")
        level = F.get(b, F.lit(0)) + F.get(b, F.lit(1)) * at / F.lit(float(per_day)) + F.get(b, F.lit(2) + F.pmod(at, F.lit(per_day)).cast("int"))
        return F.coalesce(level, F.lit(0.0))

    # In stages, so that no expression holds another many times over: compiled methods stay small enough to be optimised.
    ends_of = [(v, e) for v in values for e in "pq"]
    rows = rows.withColumns({f"_r{e}_{v}": F.col(f"_{e}_{v}.v") - predicted(v, F.col(f"_{e}_{v}.s")) for v, e in ends_of})
    rows = rows.withColumns({f"_r{e}_{v}": F.when(_finite(F.col(f"_r{e}_{v}")), F.col(f"_r{e}_{v}")).otherwise(F.lit(0.0)) for v, e in ends_of})
    rows = rows.withColumns({f"_s{e}_{v}": F.col(f"_{e}_{v}.s") for v, e in ends_of})
    rows = rows.select(*keys, "_slot", *values, *[f"_b_{v}" for v in values], *[f"_{x}{e}_{v}" for v, e in ends_of for x in "rs"], F.explode(F.sequence("_slot", "_to")).alias("_g"))
    rows = rows.withColumn("_here", F.col("_g") == F.col("_slot"))
    rows = rows.withColumns({f"_m_{v}": predicted(v, F.col("_g")) for v in values} | {f"_w_{v}": (F.col("_g") - F.col(f"_sp_{v}")) / (F.col(f"_sq_{v}") - F.col(f"_sp_{v}")) for v in values} | {v: F.when(F.col("_here"), F.col(v)) for v in values})
    rows = rows.withColumns({f"_m_{v}": F.col(f"_m_{v}") + F.col(f"_rp_{v}") * (F.lit(1.0) - F.col(f"_w_{v}")) + F.col(f"_rq_{v}") * F.col(f"_w_{v}") for v in values})
    out = [*keys, (F.col("_g") * F.lit(step_seconds)).alias("slot_start")]
    for v in values:
        between = F.col(f"_sp_{v}").isNotNull() & F.col(f"_sq_{v}").isNotNull()
        bridged = F.greatest(F.col(f"_m_{v}"), F.lit(0.0)) if v in total else F.col(f"_m_{v}")
        out += [F.col(v), F.when(F.col(v).isNotNull(), F.col(v)).when(between, bridged).alias(f"{v}_filled"), F.when(F.col(v).isNotNull(), F.lit("observed")).when(between, F.lit("modelled")).otherwise(F.lit("open")).alias(f"{v}_source")]
    return rows.select(*out)
