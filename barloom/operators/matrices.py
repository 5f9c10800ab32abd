"""Covariance matrices of a panel as tables: noise, market component, clusters, the critical line, views, distances, block markets.

A matrix is aggregated in Spark (``portfolio.moments``), treated on the driver, where the number of its assets is bounded by
``portfolio.MAX_ASSETS``, and comes back as rows (a, b, value).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.numeric import matrices as M
from barloom.numeric import portfolio as P
from barloom.numeric.clusters import kmeans_refined, silhouettes
from barloom.operators.portfolio import moments

TREATMENTS = ("raw", "denoised", "shrunk", "detoned")


def _kind(returns: DataFrame, asset: str) -> str:
    return returns.select(asset).schema[0].dataType.simpleString()


def matrix_rows(spark: SparkSession, names: Sequence, m: np.ndarray, kind: str) -> DataFrame:
    """a, b and ``value`` of a symmetric matrix, each pair once (a at or before b)."""
    i, j = np.triu_indices(len(names))
    return spark.createDataFrame([(names[a], names[b], float(m[a, b])) for a, b in zip(i, j)], f"a {kind}, b {kind}, value double")


def _correlation(returns: DataFrame, date: str, asset: str, value: str, project: bool = True) -> tuple[list, np.ndarray, float]:
    """Names of the assets with a variance, their correlations (``project``: made semidefinite) and dates an asset."""
    names, _, cov = moments(returns, date, asset, value)
    keep = [i for i in range(len(names)) if cov[i, i] > 0]
    dates = returns.where(F.col(value).isNotNull()).select(date).distinct().count()
    if not keep:
        return [], np.zeros((0, 0)), 1.0
    cov = cov[np.ix_(keep, keep)]
    return [names[i] for i in keep], M.to_correlation(M.semidefinite(cov) if project else cov), max(dates / len(keep), 1.01)


def noise_edge(returns: DataFrame, date: str, asset: str, value: str = "ret", width: float = 0.01) -> DataFrame:
    """One row: ``q`` (dates an asset), the fitted ``variance`` of pure noise, its largest eigenvalue ``edge`` and the ``factors`` above it."""
    _, corr, q = _correlation(returns, date, asset, value)
    values = M.eigen(corr)[0]
    edge, variance = M.noise_edge(values, q, width) if len(values) else (float("nan"), float("nan"))
    return returns.sparkSession.createDataFrame([(float(q), variance, edge, int((values > edge).sum()))], "q double, variance double, edge double, factors int")


def treated_correlation(returns: DataFrame, date: str, asset: str, treatment: str, value: str = "ret", alpha: float = 0.0, market: int = 1, factors: int | None = None) -> DataFrame:
    """a, b, ``value``: the correlations 'raw' (a covariance over the dates of both, the deviations over each one's own); 'denoised' (eigenvalues below the noise edge replaced by their mean); 'shrunk' (of the noise the diagonal and
    ``alpha`` of the rest); 'detoned' (without the first ``market`` components). ``factors`` sets the eigenvalues that are no noise. Assets without a
    variance are left out."""
    if treatment not in TREATMENTS:
        raise ValueError(f"treatment is one of {TREATMENTS}")
    names, corr, q = _correlation(returns, date, asset, value, treatment != "raw")
    if len(names) and treatment in ("denoised", "shrunk"):
        values = M.eigen(corr)[0]
        n = int((values > M.noise_edge(values, q)[0]).sum()) if factors is None else factors
        corr = M.denoise(corr, n) if treatment == "denoised" else M.shrink_noise(corr, n, alpha)
    elif len(names) and treatment == "detoned":
        corr = M.detone(corr, market)
    return matrix_rows(returns.sparkSession, names, corr, _kind(returns, asset))


def asset_clusters(returns: DataFrame, date: str, asset: str, value: str = "ret", most: int | None = None, seed: int = 0) -> DataFrame:
    """asset, ``cluster`` and ``silhouette``: as many clusters of correlated assets as have the best silhouettes, poor ones clustered again."""
    names, corr, _ = _correlation(returns, date, asset, value)
    labels = kmeans_refined(corr, most, seed)[0] if len(names) > 2 else np.zeros(len(names), dtype=int)
    s = silhouettes(np.sqrt((1 - np.clip(corr, -1, 1)) / 2), labels) if len(set(labels.tolist())) > 1 else np.zeros(len(names))
    return returns.sparkSession.createDataFrame([(n, int(c), float(x)) for n, c, x in zip(names, labels, s)], f"`{asset}` {_kind(returns, asset)}, cluster int, silhouette double")


def critical_line(returns: DataFrame, date: str, asset: str, solution: str, value: str = "ret", periods: float = 252, bounds=(0, 1), points: int = 100) -> DataFrame:
    """``point``, asset, ``weight``, and the point's ``mean_return`` and ``volatility``, of the solution 'cla_turning_points', 'min_volatility', 'max_sharpe' or
    'efficient_frontier'."""
    names, mu, cov = moments(returns, date, asset, value)
    mu, cov = mu * periods, M.semidefinite(cov) * periods
    out = P.critical_line_solution(cov, mu, solution, bounds, points) if names else []
    weights = [out] if solution in ("min_volatility", "max_sharpe") and names else [w[2] if isinstance(w, tuple) else w for w in out]
    rows = [(k, n, float(x), float(mu @ w), float(np.sqrt(max(w @ cov @ w, 0.0)))) for k, w in enumerate(weights) for n, x in zip(names, w)]
    return returns.sparkSession.createDataFrame(rows, f"point int, `{asset}` {_kind(returns, asset)}, weight double, mean_return double, volatility double")


def pooled_probabilities(scenarios: DataFrame, views: dict[str, tuple[Column, float]], prior: str | None = None, steps: int = 100, tolerance: float = 1e-12) -> tuple[DataFrame, dict[str, float]]:
    """Scenarios with ``probability``: closest in relative entropy to the prior (equal ones by default) such that each view's column has its mean. The multipliers
    of the views are found by Newton's method on the dual; each step is one aggregate of the scenarios, so they may be any number."""
    names = list(views)
    rows = scenarios.withColumns({f"_v{i}": c.cast("double") for i, (c, _) in enumerate(views.values())} | {"_prior": F.col(prior) if prior else F.lit(1.0)})
    goal, lam = np.array([m for _, m in views.values()]), np.zeros(len(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    power = lambda x: sum((F.lit(float(a)) * (F.col(f"_v{i}") - F.lit(float(goal[i]))) for i, a in enumerate(x)), F.lit(0.0))
    shift = 0.0
    for _ in range(steps):
        top = rows.agg(F.max(power(lam))).first()[0]  # keeps the exponentials finite
        shift = float(top or 0.0)
        w = F.col("_prior") * F.exp(power(lam) - F.lit(shift))
        d = [F.col(f"_v{i}") - F.lit(float(goal[i])) for i in range(len(names))]
        s = rows.agg(F.sum(w).alias("z"), *[F.sum(w * c).alias(f"g{i}") for i, c in enumerate(d)], *[F.sum(w * d[i] * d[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if not s.z:
            break
        g = np.array([s[f"g{i}"] / s.z for i in range(len(names))])
        if np.abs(g).max() < tolerance:
            break
        h = np.zeros((len(names), len(names)))
        for i, j in pairs:
            h[i, j] = h[j, i] = s[f"h{i}_{j}"] / s.z - g[i] * g[j]
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        lam = lam - step * min(1.0, 5.0 / max(np.abs(step * np.sqrt(np.diag(h))).max(), 1e-300))
    w = F.col("_prior") * F.exp(power(lam) - F.lit(shift))
    total = rows.agg(F.sum(w)).first()[0]
    return rows.withColumn("probability", w / F.lit(float(total or 1.0))).select(*scenarios.columns, "probability"), dict(zip(names, map(float, lam)))


def distance_weights(returns: DataFrame, date: str, asset: str, value: str = "ret", risk_free: float = 0.0) -> DataFrame:
    """asset and ``weight``: the non-negative portfolio with the highest mean return over the square root of w'Dw, D the correlation distances."""
    names, corr, _ = _correlation(returns, date, asset, value)
    mu = {r[0]: r[1] for r in returns.groupBy(asset).agg(F.avg(value)).collect()} if names else {}
    w = P.distance_optimum(np.sqrt((1 - corr) / 2), np.array([mu[n] for n in names]), risk_free) if names else []
    return returns.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, w)], f"`{asset}` {_kind(returns, asset)}, weight double")


def dynamic_weights(spark: SparkSession, mus: Sequence[Sequence[float]], covs: Sequence, costs: Sequence[Sequence[float]], units: int) -> DataFrame:
    """``horizon``, ``asset`` and ``weight`` of the path of signed weights with the highest Sharpe ratio after costs, and that ratio. All paths are
    enumerated over the tasks: a task takes the paths that begin with its first weights."""
    grid = P.signed_weights(units, len(mus[0]))
    m, c, k = [np.asarray(x, dtype=float) for x in mus], [np.asarray(x, dtype=float) for x in covs], [np.asarray(x, dtype=float) for x in costs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [P.dynamic_optimum(m, c, k, units, first=i) for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([w.ravel().tolist() for _, w in out], pa.list_(pa.float64()))], names=["sharpe", "path"])

    best = spark.range(0, len(grid), 1, min(len(grid), 64)).mapInArrow(run, "sharpe double, path array<double>").agg(F.max(F.struct("sharpe", "path")).alias("b"))
    n = len(mus[0])
    cells = best.select(F.col("b.sharpe").alias("sharpe"), F.posexplode("b.path").alias("i", "weight"))
    return cells.select(F.floor(F.col("i") / n).cast("int").alias("horizon"), F.pmod("i", F.lit(n)).cast("int").alias("asset"), "weight", "sharpe")


def block_market(spark: SparkSession, columns: int, blocks: int, least: int = 1, correlation: bool = True, seed: int = 0) -> DataFrame:
    """a, b, ``value`` of a random matrix of blocks: the covariance of a common factor and noise in each, and for ``correlation`` a market over all."""
    rng = np.random.default_rng(seed)
    m = M.random_block_correlation(columns, blocks, least, rng) if correlation else M.random_block_covariance(columns, blocks, least, 1.0, rng)
    return matrix_rows(spark, list(range(columns)), m, "int")


def antithetic_regression(spark: SparkSession, number: int = 5000, features: int = 2, seed: int = 42) -> DataFrame:
    """``id``, ``y`` and ``x_0`` ..: normal features and noise of which the second half mirrors the first, y their sum; every column has mean 0."""
    half = number // 2
    base = spark.range(half).select("id", *[F.randn(seed + i).alias(f"x_{i}") for i in range(features)], F.randn(seed + features).alias("_e"))
    mirrored = base.select((F.col("id") + half).alias("id"), *[(-F.col(c)).alias(c) for c in base.columns[1:]])
    both = base.unionByName(mirrored)
    return both.select("id", sum((F.col(f"x_{i}") for i in range(features)), F.col("_e")).alias("y"), *[f"x_{i}" for i in range(features)])
