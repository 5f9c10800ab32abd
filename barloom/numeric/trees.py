"""A small regression tree; for classes 0 and 1 the same splits minimise Gini impurity, and leaves hold the class share."""

from __future__ import annotations

import numpy as np


class Tree:
    def __init__(self, depth: int = 5, classification: bool = True, least: int = 2) -> None:
        self.depth, self.classification, self.least = depth, classification, least
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature (-1: leaf), cut, left, right, value

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> "Tree":
        self.nodes = []
        self._grow(x, y, np.ones(len(y)) if w is None else w, self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        value = float((w * y).sum() / w.sum()) if w.sum() > 0 else 0.0
        self.nodes.append((-1, 0.0, -1, -1, value))
        if depth == 0 or len(y) < 2 * self.least or np.ptp(y) == 0:
            return at
        best = (1e-12, -1, 0.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            xs, ws, ys = x[order, j], w[order], (w * y)[order]
            cw, cy = np.cumsum(ws), np.cumsum(ys)
            k = np.arange(self.least - 1, len(y) - self.least)
            k = k[xs[k] < xs[k + 1]]
            if not len(k):
                continue
            lw, rw = cw[k], cw[-1] - cw[k]
            ok = (lw > 0) & (rw > 0)
            gain = np.where(ok, cy[k] ** 2 / np.where(ok, lw, 1) + (cy[-1] - cy[k]) ** 2 / np.where(ok, rw, 1) - cy[-1] ** 2 / cw[-1], -np.inf)
            b = int(gain.argmax())
            if gain[b] > best[0]:
                best = (float(gain[b]), j, float((xs[k[b]] + xs[k[b] + 1]) / 2))
        if best[1] < 0:
            return at
        _, j, cut = best
        go = x[:, j] <= cut
        left = self._grow(x[go], y[go], w[go], depth - 1)
        right = self._grow(x[~go], y[~go], w[~go], depth - 1)
        self.nodes[at] = (j, cut, left, right, value)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while stack:
            n, ids = stack.pop()
            j, cut, left, right, value = self.nodes[n]
            if j < 0:
                out[ids] = value
            else:
                go = x[ids, j] <= cut
                stack += [(left, ids[go]), (right, ids[~go])]
        return out
