"""Minimisers for a handful of variables, and a quadratic program."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], x0: Sequence[float], bounds: Sequence[tuple[float | None, float | None]] | None = None, steps: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """The best point found and its value; points are clipped to the bounds."""
    lo = np.array([-np.inf if b is None or b[0] is None else b[0] for b in (bounds or [None] * len(x0))], dtype=float)
    hi = np.array([np.inf if b is None or b[1] is None else b[1] for b in (bounds or [None] * len(x0))], dtype=float)

    def value(x: np.ndarray) -> float:
        v = f(x)
        return v if np.isfinite(v) else 1e300

    x0 = np.clip(np.asarray(x0, dtype=float), lo, hi)
    simplex = [x0]
    for i in range(len(x0)):
        step = x0.copy()
        step[i] += 0.05 * abs(x0[i]) if x0[i] else 0.00025
        step = np.clip(step, lo, hi)
        if step[i] == x0[i]:
            step[i] = np.clip(x0[i] - (0.05 * abs(x0[i]) or 0.00025), lo[i], hi[i])
        simplex.append(step)
    points = np.array(simplex)
    values = np.array([value(x) for x in points])
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + tol) and np.abs(points[1:] - points[0]).max() <= 1e-8 * (1 + np.abs(points[0]).max()):
            break
        center = points[:-1].mean(axis=0)
        move = lambda t: np.clip(center + t * (points[-1] - center), lo, hi)
        r = move(-1.0)
        vr = value(r)
        if vr < values[0]:
            e = move(-2.0)
            ve = value(e)
            points[-1], values[-1] = (e, ve) if ve < vr else (r, vr)
        elif vr < values[-2]:
            points[-1], values[-1] = r, vr
        else:
            c = move(-0.5 if vr < values[-1] else 0.5)
            vc = value(c)
            if vc < min(vr, values[-1]):
                points[-1], values[-1] = c, vc
            else:
                points[1:] = np.clip(points[0] + 0.5 * (points[1:] - points[0]), lo, hi)
                values[1:] = [value(x) for x in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best])


def nelder_mead_many(f: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, x0: Sequence[float], steps: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """``nelder_mead`` without bounds for n functions at once, which take the same steps as alone: their best points and values. f(lanes, points) gives
    the values of the functions numbered ``lanes``, in ascending order, each at its own point."""

    def value(lanes: np.ndarray, x: np.ndarray) -> np.ndarray:
        v = f(lanes, x) if len(lanes) else np.zeros(0)
        return np.where(np.isfinite(v), v, 1e300)

    start = np.asarray(x0, dtype=float)
    simplex = np.repeat(start[None], len(start) + 1, axis=0)
    for i, x in enumerate(start):
        simplex[i + 1, i] += 0.05 * abs(x) if x else 0.00025
    everyone = np.arange(n)
    all_points = np.repeat(simplex[None], n, axis=0)
    all_values = np.stack([value(everyone, all_points[:, i]) for i in range(len(simplex))], axis=1)
    going = everyone
    for _ in range(steps):
        points, values = all_points[going], all_values[going]
        order = np.argsort(values, axis=1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)
        close = np.abs(values[:, -1] - values[:, 0]) <= tol * (np.abs(values[:, 0]) + tol)
        close &= np.abs(points[:, 1:] - points[:, :1]).max(axis=(1, 2)) <= 1e-8 * (1 + np.abs(points[:, 0]).max(axis=1))
        all_points[going], all_values[going] = points, values
        going, points, values = going[~close], points[~close], values[~close]
        if not len(going):
            break
        worst, last = points[:, -1].copy(), values[:, -1].copy()
        center = points[:, :-1].mean(axis=1)
        r = center - (worst - center)
        vr = value(going, r)
        better = vr < values[:, 0]
        kept = ~better & (vr < values[:, -2])
        t = np.where(better, -2.0, np.where(vr < last, -0.5, 0.5))
        second = np.flatnonzero(~kept)
        c, vc = r.copy(), vr.copy()
        c[second] = center[second] + t[second, None] * (worst[second] - center[second])
        vc[second] = value(going[second], c[second])
        taken = np.where(better, vc < vr, ~kept & (vc < np.minimum(vr, last)))
        points[:, -1] = np.where(taken[:, None], c, np.where((better | kept)[:, None], r, worst))
        values[:, -1] = np.where(taken, vc, np.where(better | kept, vr, last))
        shrunk = np.flatnonzero(~better & ~kept & ~taken)
        points[shrunk, 1:] = points[shrunk, :1] + 0.5 * (points[shrunk, 1:] - points[shrunk, :1])
        for i in range(1, len(simplex)):
            values[shrunk, i] = value(going[shrunk], points[shrunk, i])
        all_points[going], all_values[going] = points, values
    best = np.argmin(all_values, axis=1)
    return all_points[everyone, best], all_values[everyone, best]


def quadratic_program(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 20_000) -> np.ndarray | None:
    """Minimises x'qx / 2 + c'x with a x = b and low <= x <= high; None if no point satisfies that. Operator splitting, then an exact solve on
    the active bounds."""
    n, m = len(c), len(b)
    rho, sigma = 1.0 * max(np.trace(q) / n, 1e-6), 1e-9 + 1e-6 * max(np.trace(q) / n, 1e-6)
    kkt = np.block([[q + (sigma + rho) * np.eye(n), a.T], [a, np.zeros((m, m))]])
    inverse = np.linalg.pinv(kkt)
    z, u = np.clip(np.full(n, 1.0 / n), low, high), np.zeros(n)
    x = z.copy()
    for i in range(steps):
        x = (inverse @ np.concatenate([sigma * x - c + rho * (z - u), b]))[:n]
        before, z = z, np.clip(x + u, low, high)
        u += x - z
        if i % 50 == 0 and np.abs(x - z).max() < 1e-10 and np.abs(z - before).max() < 1e-11:
            break
    if np.abs(a @ z - b).max() > 1e-5 * max(1.0, np.abs(b).max()):
        return None
    at_low, at_high = z <= low + 1e-7, z >= high - 1e-7
    free = ~(at_low | at_high)
    if free.any():
        fixed = np.where(at_low, low, high)
        fixed[free] = 0
        k = np.block([[q[np.ix_(free, free)], a[:, free].T], [a[:, free], np.zeros((m, m))]])
        s = np.linalg.lstsq(k, np.concatenate([-c[free] - q[np.ix_(free, ~free)] @ fixed[~free], b - a[:, ~free] @ fixed[~free]]), rcond=None)[0]
        w = fixed.copy()
        w[free] = s[: free.sum()]
        if (w >= low - 1e-9).all() and (w <= high + 1e-9).all() and np.abs(a @ w - b).max() < 1e-8 * max(1.0, np.abs(b).max()):
            return np.clip(w, low, high)
    return z
