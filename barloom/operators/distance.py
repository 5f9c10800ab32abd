"""Distances between series of a panel (date, asset, value): correlation, entropy and divergence based; minimum spanning trees.

Pairs are made only between assets of one date and only once (a < b); the matrix has as many entries as the panel has pairs of
assets, whatever the number of dates.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.entropy import entropy, message, tick_letter
from barloom.operators.bars import tick_signs


def pairs(panel: DataFrame, date: str, asset: str, value: str) -> DataFrame:
    """date, ``a``, ``b``, ``x``, ``y`` for each date and pair of assets with values."""
    p = panel.where(F.col(value).isNotNull() & ~F.isnan(value)).select(date, F.col(asset).alias("a"), F.col(value).cast("double").alias("x"))
    q = p.select(date, F.col("a").alias("b"), F.col("x").alias("y"))
    return p.join(q, date).where(F.col("a") < F.col("b"))


def correlations(panel: DataFrame, date: str, asset: str, value: str, least: int = 2) -> DataFrame:
    """a, b, ``n``, ``corr`` (null where undefined) and the ranges of both."""
    out = pairs(panel, date, asset, value).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return out.where(F.col("n") >= least).withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def correlation_distance(corr: DataFrame) -> DataFrame:
    """a, b and ``distance`` sqrt(2 n (1 - corr))."""
    return corr.select("a", "b", F.sqrt(F.greatest(2 * F.col("n") * (1 - F.col("corr")), F.lit(0.0))).alias("distance"))


def bivariate_bins(n: Column, corr: Column, legacy: bool = False) -> Column:
    """Optimal number of bins of a pair; ``legacy`` multiplies where the published formula divides."""
    if legacy:
        return F.bround(math.sqrt(2) * F.sqrt(1 + F.sqrt(1 + 24 * n * (1 - corr * corr)))).cast("int")
    return F.bround(F.sqrt(1 + F.sqrt(1 + F.try_divide(24 * n, 1 - corr * corr))) / math.sqrt(2)).cast("int")


def information(panel: DataFrame, date: str, asset: str, value: str, least: int = 10, legacy_bins: bool = False) -> DataFrame:
    """a, b, ``bins``, entropies ``hx`` and ``hy`` (nats), mutual information ``mi`` and its share of hx + hy, variation of information ``vi`` and its share of the
    joint entropy. Cells of the pair's histogram are counted; three sums over the counts give all of it."""
    stats = correlations(panel, date, asset, value, least).where((F.abs("corr") < 1) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    stats = stats.withColumn("bins", F.greatest(bivariate_bins(F.col("n"), F.col("corr"), legacy_bins), F.lit(1)))
    rows = pairs(panel, date, asset, value).join(stats, ["a", "b"])
    at = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * F.col("bins")), F.col("bins") - 1)
    cells = rows.groupBy("a", "b", "n", "bins", at("x", "x0", "x1").alias("i"), at("y", "y0", "y1").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    entropy_of = lambda df, *by: df.groupBy("a", "b", "n", "bins", *by).agg(F.sum("c").alias("c")).groupBy("a", "b", "n", "bins").agg((F.ln(F.col("n")) - F.sum(F.col("c") * F.ln("c")) / F.col("n")).alias("h"))
    key = ["a", "b", "n", "bins"]
    out = entropy_of(cells, "i").withColumnRenamed("h", "hx").join(entropy_of(cells, "j").withColumnRenamed("h", "hy"), key).join(entropy_of(cells, "i", "j").withColumnRenamed("h", "hxy"), key)
    mi = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0))
    out = out.withColumn("mi", mi)
    return out.select("a", "b", "bins", "hx", "hy", "mi", F.try_divide("mi", F.col("hx") + F.col("hy")).alias("mi_share"), (F.col("hx") + F.col("hy") - 2 * F.col("mi")).alias("vi"), F.try_divide(F.col("hx") + F.col("hy") - 2 * F.col("mi"), F.col("hx") + F.col("hy") - F.col("mi")).alias("vi_share"))


def joint_entropy(panel: DataFrame, date: str, asset: str, value: str, measure: str = "plug_in", least: int = 10) -> DataFrame:
    """a, b and ``joint``: the entropies of both assets' messages of tick signs (one of ``entropy.MEASURES``) less the mutual information of their values. A message has a letter
    a date, so an asset's message is as long as the calendar."""
    signs = tick_signs(panel.select(F.col(asset).alias("_a"), F.col(date).alias("ts"), F.lit(0).alias("seq"), F.col(value).alias("price")), ["_a"])
    one = signs.groupBy("_a").agg(message(["ts"], tick_letter(F.col("sign"))).alias("_m")).select("_a", entropy(F.col("_m"), measure).alias("_e"))
    mi = information(panel, date, asset, value, least).select("a", "b", "mi")
    left, right = one.select(F.col("_a").alias("a"), F.col("_e").alias("_ea")), one.select(F.col("_a").alias("b"), F.col("_e").alias("_eb"))
    return mi.join(left, "a").join(right, "b").select("a", "b", (F.col("_ea") + F.col("_eb") - F.col("mi")).alias("joint"))


def align_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys of both tables with the columns of both, null where a table lacks the key. Null keys meet."""
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full")
    return joined.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], *[f"l.{c}" for c in left.columns if c not in keys], *[f"r.{c}" for c in right.columns if c not in keys])


def label_slice(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """The rows from ``first`` to ``last``, both included and either open: a filter that reaches the scan."""
    out = df if first is None else df.where(F.col(column) >= F.lit(first))
    return out if last is None else out.where(F.col(column) <= F.lit(last))


def gaussian_kde(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Density with a normal kernel and Scott's bandwidth."""
    n = len(points)
    h = max(points.std(ddof=1) * n ** (-1 / 5), 1e-300)
    z = (at[:, None] - points[None, :]) / h
    return np.exp(-0.5 * z * z).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))


def js_divergence(x: np.ndarray, y: np.ndarray) -> float:
    """Jensen-Shannon divergence of two kernel densities on a common grid (sums, not normalised)."""
    at = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), len(x))
    p, q = gaussian_kde(x, at), gaussian_kde(y, at)
    m = 0.5 * (p + q)
    part = lambda u: float(np.where(u > 0, u * np.log(np.where(u > 0, u, 1) / np.where(m > 0, m, 1)), 0.0).sum())
    return 0.5 * part(p) + 0.5 * part(q)


def jensen_shannon(panel: DataFrame, date: str, asset: str, value: str, least: int = 10) -> DataFrame:
    """a, b and ``distance``. A pair's dates are gathered in one task: kernel densities need all of them."""
    kind = panel.select(asset).schema[0].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        ok = len(x) >= least and x.std() > 0 and y.std() > 0
        return pd.DataFrame({"a": [pdf.a.iloc[0]], "b": [pdf.b.iloc[0]], "distance": [js_divergence(x, y) if ok else None]})

    return pairs(panel, date, asset, value).groupBy("a", "b").applyInPandas(one, f"a {kind}, b {kind}, distance double").where(F.col("distance").isNotNull())


def spanning_tree(edges: Sequence[tuple[float, object, object]]) -> list[tuple[float, object, object]]:
    """Kruskal: the edges of the minimum spanning forest of (weight, u, v), lightest first."""
    parent: dict[object, object] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for w, u, v in sorted(edges, key=lambda e: (e[0], str(e[1]), str(e[2]))):
        a, b = root(u), root(v)
        if a != b:
            parent[a] = b
            out.append((w, u, v))
    return out


def tree_path(tree: Sequence[tuple[float, object, object]], start: object, goal: object) -> tuple[float, list[object]]:
    """Length and nodes of the shortest path; infinite and empty if there is none."""
    near: dict[object, list[tuple[object, float]]] = {}
    for w, u, v in tree:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    heap, seen, n = [(0.0, 0, start, [start])], set(), 0
    while heap:
        d, _, x, path = heapq.heappop(heap)
        if x == goal:
            return d, path
        if x in seen:
            continue
        seen.add(x)
        for y, w in near.get(x, []):
            n += 1
            heapq.heappush(heap, (d + w, n, y, [*path, y]))
    return math.inf, []


def subdominant_ultrametric(tree: Sequence[tuple[float, object, object]], nodes: Sequence[object]) -> pd.DataFrame:
    """For each pair of nodes the largest edge on their path in the tree."""
    at = {x: i for i, x in enumerate(nodes)}
    d = np.full((len(nodes), len(nodes)), np.inf)
    np.fill_diagonal(d, 0.0)
    groups = {x: [x] for x in nodes}
    for w, u, v in sorted(tree, key=lambda e: e[0]):
        a, b = groups[u], groups[v]
        for x in a:
            for y in b:
                d[at[x], at[y]] = d[at[y], at[x]] = w
        merged = a + b
        for x in merged:
            groups[x] = merged
    return pd.DataFrame(d, index=list(nodes), columns=list(nodes))


def tree_of(distances: DataFrame, max_edges: int = 2_000_000) -> list[tuple[float, object, object]]:
    """Spanning tree of a distance table (a, b, distance). The table of pairs comes to the driver, so its size is checked first."""
    n = distances.count()
    if n > max_edges:
        raise ValueError(f"{n} edges exceed {max_edges}")
    return spanning_tree([(r.distance, r.a, r.b) for r in distances.where(F.col("distance").isNotNull()).select("a", "b", "distance").collect()])
