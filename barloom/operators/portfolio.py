"""Portfolios of a panel (date, asset, price): the covariance is aggregated in Spark, the weights are small dense numerics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.numeric import portfolio as P
from barloom.numeric.matrices import denoise_covariance, oas_shrinkage, semidefinite
from barloom.ordering import with_position

#: A covariance comes to the driver up to so many assets.
MAX_ASSETS = 2000
#: Returns come to the driver, for the allocations that need them, up to so many.
MAX_CELLS = 20_000_000


def panel_returns(prices: DataFrame, date: str, asset: str, price: str, log: bool = False) -> DataFrame:
    """date, asset and ``ret`` since the asset's date before."""
    before = F.lag(price).over(Window.partitionBy(asset).orderBy(date))
    r = F.ln(F.col(price) / before) if log else F.try_divide(F.col(price), before) - 1
    return prices.select(date, asset, r.alias("ret")).where("ret is not null")


def _products(n: int):
    """Per partition of dates the counts, products and sums of every two assets that a date has, a row per asset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, xy, sx = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
        for batch in batches:
            ids, values = batch.column("i"), batch.column("x")
            x, m = np.zeros((batch.num_rows, n)), np.zeros((batch.num_rows, n))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(ids.offsets)))
            at = np.asarray(ids.flatten())
            x[row, at], m[row, at] = np.asarray(values.flatten()), 1.0
            count, xy, sx = count + m.T @ m, xy + x.T @ x, sx + x.T @ m
        whole = lambda g: pa.FixedSizeListArray.from_arrays(pa.array(g.ravel()), n).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int64()), whole(count), whole(xy), whole(sx)], names=["i", "n", "xy", "sx"])

    return run


def moments(returns: DataFrame, date: str, asset: str, value: str = "ret") -> tuple[list, np.ndarray, np.ndarray]:
    """Names, means and the covariance of every two assets over the dates that both have. Each task multiplies the dates it holds into matrices of
    assets by assets, and those are added up: no pair of readings is ever a row. The number of assets is checked, as the matrix comes to the driver."""
    spark = returns.sparkSession
    names = [r[0] for r in returns.select(asset).distinct().orderBy(asset).limit(MAX_ASSETS + 1).collect()]
    if len(names) > MAX_ASSETS:
        raise ValueError(f"more than {MAX_ASSETS} assets")
    n = len(names)
    if not n:
        return [], np.zeros(0), np.zeros((0, 0))
    kind = returns.select(asset).schema[0].dataType.simpleString()
    place = F.broadcast(spark.createDataFrame(list(zip(names, range(n))), f"`{asset}` {kind}, _i int"))  # at most MAX_ASSETS rows
    rows = returns.where(F.col(value).isNotNull()).join(place, asset).groupBy(date).agg(F.collect_list(F.struct(F.col("_i"), F.col(value).cast("double").alias("_x"))).alias("_r"))
    rows = rows.select(F.col("_r._i").alias("i"), F.col("_r._x").alias("x"))
    parts = rows.mapInArrow(_products(n), "i bigint, n array<double>, xy array<double>, sx array<double>")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf.i.iloc[0]], **{c: [np.sum(np.stack(pdf[c].to_numpy()), axis=0)] for c in ("n", "xy", "sx")}})

    total = parts.groupBy("i").applyInPandas(add, "i bigint, n array<double>, xy array<double>, sx array<double>").collect()
    count, xy, sx = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
    for r in total:
        count[r.i], xy[r.i], sx[r.i] = r.n, r.xy, r.sx
    cov = np.divide(xy - sx * sx.T / np.maximum(count, 1), count - 1, out=np.zeros((n, n)), where=count > 1)
    return names, np.diag(sx) / np.maximum(np.diag(count), 1), (cov + cov.T) / 2


SOLUTIONS = ("inverse_variance", "min_volatility", "max_sharpe", "efficient_risk", "hierarchical_risk_parity", "nested_clusters", "closed_form", "critical_line", *(f"cluster_{m}" for m in P.ALLOCATIONS))


def allocate(returns: DataFrame, date: str, asset: str, solution: str, risk_free: float = 0.0, target: float | None = None, bounds=(0, 1), periods: float = 252, denoised: bool = False, shrunk: bool = False, value: str = "ret") -> DataFrame:
    """asset and ``weight`` by one of ``SOLUTIONS``; ``denoised`` and ``shrunk`` treat the covariance first. The rows of returns come to the driver only for ``shrunk`` and for
    allocations by shortfall or drawdown, which need every date; there an asset
    without a return on a date counts as unchanged."""
    if solution not in SOLUTIONS:
        raise ValueError(f"solution is one of {SOLUTIONS}")
    names, mu, cov = moments(returns, date, asset, value)
    mu, cov = mu * periods, semidefinite(cov) * periods
    by_date = None
    if shrunk or solution.endswith(("shortfall", "drawdown_risk")):
        if returns.count() > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} returns")
        wide = returns.groupBy(date).pivot(asset, names).agg(F.first(value)).orderBy(date).toPandas().drop(columns=[date])
        by_date = wide.fillna(0.0).to_numpy(float)
        if shrunk and len(by_date) > 1:
            cov = oas_shrinkage(by_date) * periods
    if denoised:
        n = returns.select(date).distinct().count()
        cov = denoise_covariance(cov, max(n / len(names), 1.01))
    w = {
        "inverse_variance": lambda: P.inverse_variance(cov),
        "min_volatility": lambda: P.min_volatility(cov, bounds),
        "max_sharpe": lambda: P.max_sharpe(cov, mu, risk_free, bounds),
        "efficient_risk": lambda: P.efficient_risk(cov, mu, target if target is not None else float(mu.mean()), bounds),
        "hierarchical_risk_parity": lambda: P.hierarchical_risk_parity(cov),
        "nested_clusters": lambda: P.nested_clusters(cov),
        "closed_form": lambda: P.closed_form(cov),
        "critical_line": lambda: P.critical_line_solution(cov, mu, "min_volatility", bounds),
    }
    weights = w[solution]() if solution in w else P.cluster_allocation(cov, solution.removeprefix("cluster_"), mu, by_date)
    kind = returns.select(asset).schema[0].dataType.simpleString()
    return returns.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, weights)], f"`{asset}` {kind}, weight double")


def portfolio_returns(returns: DataFrame, weights: DataFrame, date: str, asset: str, value: str = "ret") -> DataFrame:
    """date and ``ret`` of fixed weights. The weights are a row per asset."""
    return returns.join(weights, asset).groupBy(date).agg(F.sum(F.col(value) * F.col("weight")).alias("ret"))


def exponential_mean(returns: DataFrame, date: str, asset: str, span: float = 500, periods: float = 252, value: str = "ret") -> DataFrame:
    """asset and ``mean_return``: the last exponentially weighted mean of returns, a year. Weights depend on the rank from the end only, so it is one aggregate over positions."""
    rows = with_position(returns, [asset], date, [], cell_us=366)
    n = rows.groupBy(asset).agg(F.count(F.lit(1)).alias("_n"))
    w = F.pow(F.lit(1 - 2 / (span + 1)), (F.col("_n") - 1 - F.col("_pos")).cast("double"))
    return rows.join(n, asset).groupBy(asset).agg((F.sum(w * F.col(value)) / F.sum(w) * periods).alias("mean_return"))
