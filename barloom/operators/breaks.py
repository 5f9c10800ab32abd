"""Structural breaks: Chow-type and CUSUM tests, supremum ADF.

The Chow-type test needs sums up to each time only and runs as running aggregates. The other two compare every end with
every start: the work is quadratic in a series' length by definition. A series is gathered once as an array and its ends are
cut in blocks, so the blocks of one series run as separate tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.ordering import running, with_position

DAY = 86_400_000_000


def chow_statistics(series: DataFrame, keys: Sequence[str], order: str, value: str, min_length: int = 20, cell_us: int = DAY) -> DataFrame:
    """keys, order and ``statistic``: the t value of the coefficient on the lagged level, without intercept, when the level is 0 up to the time. The first and
    last ``min_length`` times have none."""
    rows = with_position(running(series, keys, order, [], {"_x": ("last", value)}, inclusive=False, cell_us=cell_us), keys, order, [], cell_us)
    rows = rows.withColumn("_y", F.col(value) - F.col("_x"))
    rows = running(rows, keys, order, [], {"_cxy": ("sum", F.col("_x") * F.col("_y")), "_cxx": ("sum", F.col("_x") * F.col("_x"))}, cell_us=cell_us)
    all_ = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_x") * F.col("_y")).alias("_sxy"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"), F.sum(F.col("_y") * F.col("_y")).alias("_syy"))
    rows = rows.join(all_, list(keys)).where((F.col("_pos") >= min_length) & (F.col("_pos") < F.col("_n") - min_length))
    # The level of the row at the time itself is the next one's lag; lags at or before the time are 0.
    xy, xx = F.col("_sxy") - F.coalesce("_cxy", F.lit(0.0)), F.col("_sxx") - F.coalesce("_cxx", F.lit(0.0))
    b = F.try_divide(xy, xx)
    variance = F.try_divide(F.col("_syy") - b * xy, (F.col("_n") - 2).cast("double"))
    return rows.select(*keys, order, F.try_divide(b, F.sqrt(F.try_divide(variance, xx))).alias("statistic"))


def by_end_blocks(series: DataFrame, keys: Sequence[str], order: str, value: str, fn: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], outputs: Sequence[str], block: int = 256) -> DataFrame:
    """keys, order and ``outputs`` (doubles): ``fn(values, first, last)`` gives them for the ends [first, last) of a series."""
    item = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    rows = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    rows = rows.select(*keys, F.transform("_s", lambda x: x["o"]).alias("_o"), F.transform("_s", lambda x: x["v"]).alias("_v"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / block)))).repartition(*keys, "_b")
    kept = series.select(*keys, order).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{o} double" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, o = np.asarray(batch.column("_v")[i].values), batch.column("_o")[i].values
                first = batch.column("_b")[i].as_py() * block
                last = min(first + block, len(v))
                out = fn(v, first, last)
                columns = [pa.array([batch.column(k)[i].as_py()] * (last - first), batch.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, o.slice(first, last - first), *[pa.array(out[c], pa.float64(), from_pandas=True) for c in outputs]], names=[*keys, order, *outputs])

    return rows.mapInArrow(run, schema)


def _csw(two_sided: bool):
    def fn(y: np.ndarray, first: int, last: int) -> dict[str, np.ndarray]:
        squares = np.concatenate([[0.0], np.cumsum(np.diff(y) ** 2)])
        stat, crit = np.full(last - first, np.nan), np.full(last - first, np.nan)
        for t in range(max(first, 2), last):
            d = y[t] - y[:t]
            gap = np.arange(t, 0, -1.0)
            s2 = squares[t] / (t - 1)
            if s2 <= 0:
                continue
            s = (np.abs(d) if two_sided else d) / (s2 * np.sqrt(gap))
            k = int(np.argmax(s))
            stat[t - first], crit[t - first] = s[k], math.sqrt(4.6 + math.log(gap[k]))
        return {"statistic": stat, "critical_value": crit}

    return fn


def cusum_statistics(series: DataFrame, keys: Sequence[str], order: str, value: str, two_sided: bool = False) -> DataFrame:
    """keys, order, ``statistic`` and ``critical_value``: the largest (y_t - y_n) / (s2 sqrt(t - n)) over earlier n, s2 the mean squared change (by t - 1), and the
    critical value at that n. From the third time on."""
    return by_end_blocks(series, keys, order, value, _csw(two_sided), ["statistic", "critical_value"]).where(F.col("statistic").isNotNull())


SADF_MODELS = ("linear", "quadratic", "sm_poly_1", "sm_poly_2", "sm_exp", "sm_power")


def sadf_design(y: np.ndarray, model: str, lags: Sequence[int], constant: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Regressors with the tested one first, the regressand, and how many leading times are lost."""
    if model not in SADF_MODELS:
        raise ValueError(f"model is one of {SADF_MODELS}")
    lost = 1 + max(lags, default=0)
    n = len(y) - lost
    if n <= 0:
        return np.zeros((0, 1)), np.zeros(0), lost
    dy = np.diff(y)
    trend, one = np.arange(n, dtype=float), np.ones(n)
    if model in ("linear", "quadratic"):
        lagged = [dy[lost - 1 - k : len(dy) - k] for k in lags]
        x = [y[lost - 1 : -1], *lagged, *([one] if constant else []), trend if model == "linear" else trend**2]
        return np.column_stack(x), dy[lost - 1 :], lost
    z = y[lost:] if model == "sm_poly_1" else np.log(y[lost:])
    with np.errstate(divide="ignore"):
        x = {"sm_poly_1": [trend**2, one, trend], "sm_poly_2": [trend**2, one, trend], "sm_exp": [trend, one], "sm_power": [np.log(trend), one]}[model]
    return np.column_stack(x), z, lost


def sadf_values(y: np.ndarray, first: int, last: int, model: str, lags: Sequence[int], constant: bool, min_length: int) -> np.ndarray:
    """The largest t value of the tested regressor over all starts, for the ends [first, last) of a series; NaN before there are ``min_length`` rows more."""
    x, z, lost = sadf_design(y, model, lags, constant)
    out, p = np.full(last - first, np.nan), x.shape[1]
    if not len(z):
        return out
    clean = np.isfinite(x).all(axis=1) & np.isfinite(z)
    x, z = np.where(clean[:, None], x, 0.0), np.where(clean, z, 0.0)
    zero = lambda a: np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
    xx, xy, yy, nn = zero(x[:, :, None] * x[:, None, :]), zero(x * z[:, None]), zero(z * z), zero(clean.astype(float))
    for end in range(max(first, lost + min_length), last):
        e = end - lost + 1
        starts = np.arange(0, e - min_length + 1)
        a, b, c, n = xx[e] - xx[starts], xy[e] - xy[starts], yy[e] - yy[starts], nn[e] - nn[starts]
        scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
        scaled = a / scale[:, :, None] / scale[:, None, :]
        ok = np.abs(np.linalg.det(scaled)) > 1e-10
        if not ok.any():
            continue
        inv = np.linalg.inv(scaled[ok]) / scale[ok][:, :, None] / scale[ok][:, None, :]
        beta = (inv @ b[ok][:, :, None])[:, :, 0]
        sse = np.maximum(c[ok] - (beta * b[ok]).sum(axis=1), 0.0)
        free = n[ok] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta[:, 0] / np.sqrt(sse / free * inv[:, 0, 0])
        t = t[(free > 0) & np.isfinite(t)]
        if len(t):
            out[end - first] = t.max()
    return out


def sadf(series: DataFrame, keys: Sequence[str], order: str, value: str, model: str = "linear", lags: int | Sequence[int] = 1, min_length: int = 20, constant: bool = False) -> DataFrame:
    """keys, order and ``sadf``."""
    which = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    fn = lambda y, a, b: {"sadf": sadf_values(y, a, b, model, which, constant, min_length)}
    return by_end_blocks(series, keys, order, value, fn, ["sadf"], block=128).where(F.col("sadf").isNotNull())
