"""Simulated price paths, regimes and strategies. Paths are made in blocks inside tasks, each block from its own seed, so that a lost task is made
again alike."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _blocks(spark: SparkSession, n: int, block: int) -> DataFrame:
    return spark.range(0, (n + block - 1) // block, 1)


def _paths(spark: SparkSession, n: int, steps: int, seed: int, make, block: int = 1000) -> DataFrame:
    """path, step and value; ``make(rng, k)`` gives k paths of steps + 1 values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                k = min(block, n - b * block)
                x = make(np.random.default_rng([seed, b]), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k) + b * block, steps + 1)), pa.array(np.tile(np.arange(steps + 1), k).astype(np.int32)), pa.array(x.ravel())], names=["path", "step", "value"])

    return _blocks(spark, n, block).mapInArrow(run, "path bigint, step int, value double")


class MonteCarlo:
    """Euler schemes with a rate, a start, a maturity in years, a volatility and a dividend yield over ``steps`` steps."""

    def __init__(self, spark: SparkSession, rate: float, start: float, maturity: float, sigma: float, dividend: float = 0.0, paths: int = 1000, steps: int = 100, seed: int = 0) -> None:
        self.spark, self.rate, self.start, self.sigma, self.dividend = spark, rate, start, sigma, dividend
        self.paths, self.steps, self.seed, self.dt = paths, steps, seed, maturity / steps

    def _walk(self, first: float, step) -> DataFrame:
        steps, dt = self.steps, self.dt

        def make(rng: np.random.Generator, k: int) -> np.ndarray:
            x = np.full((k, steps + 1), first, dtype=float)
            for t in range(1, steps + 1):
                x[:, t] = step(rng, x[:, t - 1], dt)
            return x

        return _paths(self.spark, self.paths, steps, self.seed, make)

    def geometric(self) -> DataFrame:
        drift, vol, start, steps = (self.rate - self.dividend - self.sigma**2 / 2) * self.dt, self.sigma * math.sqrt(self.dt), self.start, self.steps

        def make(rng: np.random.Generator, k: int) -> np.ndarray:
            x = np.zeros((k, steps + 1))
            x[:, 1:] = np.cumsum(drift + vol * rng.standard_normal((k, steps)), axis=1)
            return start * np.exp(x)

        return _paths(self.spark, self.paths, steps, self.seed, make)

    def vasicek(self, kappa: float, theta: float, sigma: float) -> DataFrame:
        return self._walk(self.rate, lambda rng, r, dt: r + kappa * (theta - r) * dt + sigma * math.sqrt(dt) * rng.standard_normal(len(r)))

    def square_root(self, kappa: float, theta: float, sigma: float) -> DataFrame:
        """Cox-Ingersoll-Ross; needs 2 kappa theta > sigma squared."""
        if not 2 * kappa * theta > sigma**2:
            raise ValueError("2 kappa theta must exceed sigma squared")
        return self._walk(self.rate, lambda rng, r, dt: np.maximum(r + kappa * (theta - r) * dt + sigma * np.sqrt(r * dt) * rng.standard_normal(len(r)), 0))

    def ornstein_uhlenbeck(self, kappa: float, theta: float, sigma: float) -> DataFrame:
        return self._walk(self.start, lambda rng, x, dt: x + kappa * (theta - x) * dt + sigma * math.sqrt(dt) * rng.standard_normal(len(x)))

    def heston(self, kappa: float, theta: float, sigma_v: float, rho: float = 0.0) -> DataFrame:
        steps, dt, rate, start, v0 = self.steps, self.dt, self.rate, self.start, self.sigma**2

        def make(rng: np.random.Generator, k: int) -> np.ndarray:
            x, v = np.full((k, steps + 1), start, dtype=float), np.full(k, v0)
            for t in range(1, steps + 1):
                a = rng.standard_normal(k)
                b = rho * a + math.sqrt(1 - rho**2) * rng.standard_normal(k)
                x[:, t] = x[:, t - 1] * (1 + rate * dt + np.sqrt(v * dt) * a)
                v = np.maximum(v + kappa * (theta - v) * dt + sigma_v * np.sqrt(v * dt) * b, 0)
            return x

        return _paths(self.spark, self.paths, steps, self.seed, make)

    def jump_diffusion(self, intensity: float, mean: float, std: float) -> DataFrame:
        """Geometric diffusion from the start price plus normal jumps at a Poisson rate."""
        rate, sigma = self.rate, self.sigma

        def step(rng: np.random.Generator, x: np.ndarray, dt: float) -> np.ndarray:
            n = rng.poisson(intensity * dt, len(x))
            jumps = n * mean + np.sqrt(n) * std * rng.standard_normal(len(x))
            return x * np.exp((rate - sigma**2 / 2) * dt + sigma * math.sqrt(dt) * rng.standard_normal(len(x))) + jumps

        return self._walk(self.start, step)


def autoregressive(spark: SparkSession, coefficients: Sequence[float], paths: int, steps: int, seed: int = 0) -> DataFrame:
    """path, step and value of AR(p) with unit normal errors, starting at 0; the coefficients belong to lags p .. 1."""
    c = np.asarray(coefficients, dtype=float)
    p = len(c)

    def make(rng: np.random.Generator, k: int) -> np.ndarray:
        x = np.zeros((k, steps + 1))
        for t in range(p, steps + 1):
            x[:, t] = x[:, t - p : t] @ c + rng.standard_normal(k)
        return x

    return _paths(spark, paths, steps, seed, make)


class Regimes:
    """AR(3) returns in blocks of ``inner`` steps, each in a positive or, with the switch probability, a negative regime with drift -0.0001."""

    def __init__(self, initial: Sequence[float], inner: int, positive: Sequence[float], negative: Sequence[float], std: float) -> None:
        self.initial, self.inner, self.positive, self.negative, self.std = initial, inner, np.array(positive), np.array(negative), std

    def _walk(self, rng: np.random.Generator, phi: np.ndarray, steps: int, drift: float) -> list[float]:
        last, out = np.array(self.initial, dtype=float), []
        for _ in range(steps):
            r = drift + float(phi @ last) + rng.normal(0, self.std)
            out.append(r)
            last = np.array([r, *last[:2]])
        return out

    def single(self, steps: int, drift: float = 0.0, seed: int = 0) -> list[tuple[int, float, int]]:
        return [(i, r, 0) for i, r in enumerate(self._walk(np.random.default_rng(seed), self.positive, steps, drift))]

    def dual(self, steps: int, switch: float, seed: int = 0) -> list[tuple[int, float, int]]:
        """(step, return, regime)."""
        rng, out = np.random.default_rng(seed), []
        for _ in range(steps // self.inner):
            flag = int(rng.random() < switch)
            part = self._walk(rng, self.negative if flag else self.positive, self.inner, -0.0001 if flag else 0.0)
            out += [(r, flag) for r in part]
        return [(i, r, f) for i, (r, f) in enumerate(out)]

    def series(self, spark: SparkSession, count: int, steps: int, switch: float, seed: int = 0) -> DataFrame:
        """series, step, ret and flag of ``count`` independent dual-regime series."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    rows = me.dual(steps, switch, seed + i)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32())], names=["series", "step", "ret", "flag"])

        return spark.range(count).mapInArrow(run, "series bigint, step int, ret double, flag int")


def mixed_normals(n: int, mu1: float, mu2: float, s1: float, s2: float, p1: float, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = int(n * p1)
    x = np.concatenate([rng.normal(mu1, s1, k), rng.normal(mu2, s2, n - k)])
    rng.shuffle(x)
    return x


def synthetic_backtest(spark: SparkSession, forecast: float, half_life: float, sigma: float, profits: Sequence[float], stops: Sequence[float], iterations: int = 10_000, longest: int = 100, start: float = 0.0, seed: int = 0) -> DataFrame:
    """profit, stop, ``mean``, ``std`` and ``sharpe`` of an Ornstein-Uhlenbeck price left at a profit, a stop or after ``longest`` steps, for the grid of both.
    One task per cell of the grid and block of paths; blocks are merged by sums."""
    phi = 2 ** (-1 / half_life)
    block = 2000
    cells = [(float(p), float(s), b) for p in profits for s in stops for b in range((iterations + block - 1) // block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, s, b in zip(*(batch.column(c).to_pylist() for c in ("profit", "stop", "block"))):
                rng, k = np.random.default_rng([seed, b, int(p * 1000), int(s * 1000)]), min(block, iterations - b * block)
                x, gain, live = np.full(k, start), np.zeros(k), np.ones(k, dtype=bool)
                for hold in range(1, longest + 2):
                    x[live] = (1 - phi) * forecast + phi * x[live] + sigma * rng.standard_normal(live.sum())
                    done = live & ((x - start > p) | (x - start < -s) | (hold > longest))
                    gain[done] = x[done] - start
                    live &= ~done
                    if not live.any():
                        break
                out.append((p, s, k, gain.sum(), (gain * gain).sum()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()])], names=["profit", "stop", "n", "s", "ss"])

    grid = spark.createDataFrame(cells, "profit double, stop double, block long").repartition(max(1, min(len(cells), 64)))
    sums = grid.mapInArrow(run, "profit double, stop double, n bigint, s double, ss double").groupBy("profit", "stop").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    out = sums.select("profit", "stop", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
    return out.withColumn("sharpe", F.try_divide("mean", "std"))


def maximum_sharpe_distribution(spark: SparkSession, trials: Sequence[int], simulations: int, std: float = 1.0, mean: float = 0.0, seed: int = 0) -> DataFrame:
    """trials and ``max_sr`` of each simulation: the largest of so many standardised normal Sharpe ratios."""
    cells = [(int(n), b) for n in trials for b in range((simulations + 999) // 1000)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, b in zip(batch.column("trials").to_pylist(), batch.column("block").to_pylist()):
                k = min(1000, simulations - b * 1000)
                x = np.random.default_rng([seed, n, b]).standard_normal((k, n))
                x = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([n] * k, pa.int64()), pa.array(mean + std * x.max(axis=1))], names=["trials", "max_sr"])

    return spark.createDataFrame(cells, "trials long, block long").mapInArrow(run, "trials bigint, max_sr double")
