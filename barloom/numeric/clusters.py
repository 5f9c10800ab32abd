"""K-means on a distance matrix with the number of clusters chosen by silhouettes."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10, steps: int = 100) -> np.ndarray:
    best, labels = np.inf, np.zeros(len(x), dtype=int)
    for _ in range(starts):
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:  # spread starts
            d = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
            centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
        for _ in range(steps):
            d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
            lab = d.argmin(axis=1)
            new = np.array([x[lab == c].mean(axis=0) if (lab == c).any() else centers[c] for c in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        inertia = d[np.arange(len(x)), lab].sum()
        if inertia < best:
            best, labels = inertia, lab
    return labels


def silhouettes(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = np.zeros(len(x))
    groups = [np.flatnonzero(labels == c) for c in np.unique(labels)]
    for g in groups:
        for i in g:
            if len(g) == 1:
                continue
            a = d[i, g].sum() / (len(g) - 1)
            b = min((d[i, h].mean() for h in groups if h is not g), default=0.0)
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def _quality(s: np.ndarray) -> float:
    return s.mean() / s.std() if s.std() > 0 else -np.inf


def kmeans_select(corr: np.ndarray, most: int = 10, starts: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Labels and silhouettes of the best mean / standard deviation of silhouettes, over 2 .. most clusters."""
    rng = np.random.default_rng(seed)
    x = np.sqrt((1 - np.clip(np.nan_to_num(corr), -1, 1)) / 2)
    best = (-np.inf, np.zeros(len(x), dtype=int), np.zeros(len(x)))
    for _ in range(starts):
        for k in range(2, max(2, min(most, len(x) // 2)) + 1):
            if k > len(x):
                continue
            labels = kmeans(x, k, rng)
            s = silhouettes(x, labels)
            if _quality(s) > best[0]:
                best = (_quality(s), labels, s)
    return best[1], best[2]


def kmeans_refined(corr: np.ndarray, most: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Clusters whose silhouettes' t value is below the average are clustered again, as long as that raises the average."""
    most = min(most or len(corr) - 1, len(corr) - 1)
    labels, s = kmeans_select(corr, most, seed=seed)
    quality = {c: _quality(s[labels == c]) for c in np.unique(labels)}
    mean = np.mean(list(quality.values()))
    again = [c for c, q in quality.items() if q < mean]
    if len(again) <= 2:
        return labels, s
    ids = np.flatnonzero(np.isin(labels, again))
    if len(ids) < 4:
        return labels, s
    sub, _ = kmeans_refined(corr[np.ix_(ids, ids)], min(most, len(ids) - 1), seed + 1)
    new = np.unique(labels, return_inverse=True)[1]
    new[ids] = new.max() + 1 + sub
    x = np.sqrt((1 - np.clip(np.nan_to_num(corr), -1, 1)) / 2)
    s2 = silhouettes(x, new)
    return (labels, s) if np.mean([_quality(s2[new == c]) for c in np.unique(new)]) <= mean else (new, s2)
