"""Covariance matrices: conversion, shrinkage, noise, blocks."""

from __future__ import annotations

import math

import numpy as np

from barloom.numeric.optimize import nelder_mead


def to_correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def to_covariance(corr: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return corr * np.outer(sd, sd)


def semidefinite(matrix: np.ndarray) -> np.ndarray:
    """The covariance without negative eigenvalues, which pairwise covariances over different dates may have: the correlations are projected,
    the variances stay."""
    sd = np.sqrt(np.maximum(np.diag(matrix), 0))
    sd = np.where(sd > 0, sd, 1.0)
    values, vectors = np.linalg.eigh(matrix / np.outer(sd, sd))
    if not len(values) or values[0] >= 0:
        return matrix
    out = (vectors * np.maximum(values, 1e-10 * values[-1])) @ vectors.T
    unit = np.sqrt(np.maximum(np.diag(matrix), 0) / np.maximum(np.diag(out), 1e-300))
    out = out * np.outer(unit, unit)
    return (out + out.T) / 2


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh(matrix)
    return values[::-1], vectors[:, ::-1]


def oas_shrinkage(x: np.ndarray) -> np.ndarray:
    """Oracle-approximating shrinkage of the covariance of rows towards a multiple of the identity."""
    n, p = x.shape
    s = np.cov(x, rowvar=False, bias=True).reshape(p, p)
    mu = np.trace(s) / p
    alpha = (s * s).mean()
    top, bottom = alpha + mu**2, (n + 1) * (alpha - mu**2 / p)
    k = 1.0 if bottom == 0 else min(top / bottom, 1.0)
    return (1 - k) * s + k * mu * np.eye(p)


def marchenko_pastur(variance: float, q: float, points: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and density of pure noise; q is observations over variables."""
    lo, hi = variance * (1 - math.sqrt(1 / q)) ** 2, variance * (1 + math.sqrt(1 / q)) ** 2
    x = np.linspace(lo, hi, points)
    return x, q / (2 * math.pi * variance * x) * np.sqrt(np.maximum((hi - x) * (x - lo), 0))


def kernel_density(points: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
    z = (at[:, None] - points[None, :]) / width
    return np.exp(-0.5 * z * z).sum(axis=1) / (len(points) * width * math.sqrt(2 * math.pi))


def noise_edge(values: np.ndarray, q: float, width: float = 0.01) -> tuple[float, float]:
    """The largest eigenvalue that noise explains, and its fitted variance."""

    def error(v: np.ndarray) -> float:
        x, density = marchenko_pastur(float(v[0]), q)
        return float(((kernel_density(values, x, width) - density) ** 2).sum())

    fit, _ = nelder_mead(error, [0.5], [(1e-5, 1 - 1e-5)], 200)
    return float(fit[0] * (1 + math.sqrt(1 / q)) ** 2), float(fit[0])


def denoise(corr: np.ndarray, factors: int) -> np.ndarray:
    """Eigenvalues behind the first ``factors`` replaced by their mean."""
    values, vectors = eigen(corr)
    values = values.copy()
    values[factors:] = values[factors:].mean() if factors < len(values) else 0
    return to_correlation((vectors * values) @ vectors.T)


def shrink_noise(corr: np.ndarray, factors: int, alpha: float = 0.0) -> np.ndarray:
    """The signal part, and of the noise part the diagonal and alpha of the rest."""
    values, vectors = eigen(corr)
    signal = (vectors[:, :factors] * values[:factors]) @ vectors[:, :factors].T
    noise = (vectors[:, factors:] * values[factors:]) @ vectors[:, factors:].T
    return signal + alpha * noise + (1 - alpha) * np.diag(np.diag(noise))


def detone(corr: np.ndarray, market: int = 1) -> np.ndarray:
    """Without the first ``market`` components."""
    values, vectors = eigen(corr)
    return to_correlation(corr - (vectors[:, :market] * values[:market]) @ vectors[:, :market].T)


def denoise_covariance(cov: np.ndarray, q: float, width: float = 0.01) -> np.ndarray:
    corr = to_correlation(cov)
    values, _ = eigen(corr)
    edge, _ = noise_edge(values, q, width)
    factors = int((values > edge).sum())
    return to_covariance(denoise(corr, factors), np.sqrt(np.diag(cov)))


def block_diagonal(*blocks: np.ndarray) -> np.ndarray:
    n = sum(len(b) for b in blocks)
    out, at = np.zeros((n, n)), 0
    for b in blocks:
        out[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return out


def block_correlation(blocks: int, size: int, corr: float) -> np.ndarray:
    b = np.full((size, size), corr)
    np.fill_diagonal(b, 1)
    return block_diagonal(*[b] * blocks)


def random_block_covariance(columns: int, blocks: int, least: int = 1, sigma: float = 1.0, rng: np.random.Generator | None = None) -> np.ndarray:
    """Blocks of random sizes, each the covariance of one common factor plus noise."""
    rng = rng or np.random.default_rng()
    free = columns - least * blocks
    cuts = np.sort(rng.integers(0, free + 1, blocks - 1))
    sizes = np.diff(np.concatenate([[0], cuts, [free]])) + least

    def one(k: int) -> np.ndarray:
        if k == 1:
            return np.ones((1, 1))
        n = max(k * (k + 1) // 2, 100)
        return np.cov(rng.normal(size=(n, 1)) + rng.normal(scale=sigma, size=(n, k)), rowvar=False)

    return block_diagonal(*[one(int(k)) for k in sizes if k])


def random_block_correlation(columns: int, blocks: int, least: int = 1, rng: np.random.Generator | None = None) -> np.ndarray:
    rng = rng or np.random.default_rng()
    return to_correlation(random_block_covariance(columns, blocks, least, 0.5, rng) + random_block_covariance(columns, 1, least, 1.0, rng))


def true_market(blocks: int, size: int, corr: float, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance of a shuffled block market."""
    rng = rng or np.random.default_rng()
    c = block_correlation(blocks, size, corr)
    order = rng.permutation(len(c))
    sd = rng.uniform(0.05, 0.2, len(c))
    return rng.normal(sd, sd), to_covariance(c[np.ix_(order, order)], sd)


def simulate_moments(mu: np.ndarray, cov: np.ndarray, n: int, shrink: bool = False, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sample mean and covariance of n normal draws."""
    rng = rng or np.random.default_rng()
    x = rng.multivariate_normal(mu, cov, n)
    return x.mean(axis=0), oas_shrinkage(x) if shrink else np.cov(x, rowvar=False)


def orthogonal_components(x: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the standardised columns' products, as many as reach the share of variance."""
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = eigen(z.T @ z)
    keep = int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    return values[:keep], vectors[:, :keep]


def random_of_rank(rows: int, rank: int, sigma: float = 0.0, homogeneous: bool = True, rng: np.random.Generator | None = None) -> np.ndarray:
    """A random matrix of observations whose columns have a rank, with noise of the same or of different sizes."""
    rng = rng or np.random.default_rng()
    q, _, _ = np.linalg.svd(rng.standard_normal((rows, rows)))
    x = rng.standard_normal((rows, rank)) @ q[:, :rank].T
    return x + sigma * (1.0 if homogeneous else rng.random(rows) + 0.5) * rng.standard_normal((rows, rows))
