"""Portfolio weights from means and covariances."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import product

import numpy as np

from barloom.numeric.clusters import kmeans_select
from barloom.numeric.matrices import to_correlation
from barloom.numeric.optimize import nelder_mead, quadratic_program


def inverse_variance(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def _bounds(bounds, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A pair for all assets, or a dict of pairs by position (0 to 1 where missing); nothing above 1."""
    each = [bounds] * n if isinstance(bounds, tuple) else [bounds.get(i, (0, 1)) for i in range(n)]
    return np.array([b[0] for b in each], dtype=float), np.minimum(np.array([b[1] for b in each], dtype=float), 1.0)


def min_volatility(cov: np.ndarray, bounds=(0, 1)) -> np.ndarray:
    n = len(cov)
    w = quadratic_program(cov, np.zeros(n), np.ones((1, n)), np.ones(1), *_bounds(bounds, n))
    if w is None:
        raise ValueError("no weights satisfy the bounds")
    return w


def efficient_risk(cov: np.ndarray, mu: np.ndarray, target: float, bounds=(0, 1)) -> np.ndarray:
    """Least variance with the target return."""
    n = len(cov)
    w = quadratic_program(cov, np.zeros(n), np.vstack([np.ones(n), mu]), np.array([1.0, target]), *_bounds(bounds, n))
    if w is None:
        raise ValueError("no weights reach the target return")
    return w


def max_sharpe(cov: np.ndarray, mu: np.ndarray, risk_free: float = 0.05, bounds=(0, 1)) -> np.ndarray:
    """The weights of highest (return - risk free) / volatility: along the efficient frontier the ratio has one peak, found by golden section."""
    lo_w = min_volatility(cov, bounds)
    lo, hi = float(mu @ lo_w), _highest_return(mu, bounds)
    if hi <= risk_free:
        raise ValueError("no return exceeds the risk-free rate")

    def ratio(r: float) -> float:
        w = quadratic_program(cov, np.zeros(len(cov)), np.vstack([np.ones(len(cov)), mu]), np.array([1.0, r]), *_bounds(bounds, len(cov)), steps=4000)
        return -np.inf if w is None else (mu @ w - risk_free) / math.sqrt(max(w @ cov @ w, 1e-300))

    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = ratio(c), ratio(d)
    for _ in range(40):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = ratio(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = ratio(d)
    return efficient_risk(cov, mu, (a + b) / 2, bounds)


def _highest_return(mu: np.ndarray, bounds) -> float:
    low, high = _bounds(bounds, len(mu))
    w, left = low.copy(), 1 - low.sum()
    for i in np.argsort(-mu):
        add = min(left, high[i] - low[i])
        w[i] += add
        left -= add
    return float(mu @ w)


def efficient_frontier(cov: np.ndarray, mu: np.ndarray, low: float, high: float, points: int = 100, bounds=(0, 1)) -> list[tuple[float, float]]:
    """(return, volatility) of the least variance at each reachable target return."""
    out = []
    for r in np.linspace(low, high, points):
        try:
            w = efficient_risk(cov, mu, float(r), bounds)
        except ValueError:
            continue
        out.append((float(r), math.sqrt(w @ cov @ w)))
    return out


def closed_form(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    """Inverse covariance x mean (ones: least variance), scaled to sum 1."""
    w = np.linalg.solve(cov, np.ones(len(cov)) if mu is None else mu)
    return w / w.sum()


# Hierarchical allocation.


def single_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size); merge k makes cluster n + k."""
    n = len(distance)
    i, j = np.triu_indices(n, 1)
    order = np.argsort(distance[i, j], kind="stable")
    top, size, merges = list(range(n)), {x: 1 for x in range(n)}, []
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in order:
        a, b = find(int(i[k])), find(int(j[k]))
        if a == b:
            continue
        left, right = sorted((top[a], top[b]))
        root[b] = a
        top[a] = n + len(merges)
        size[top[a]] = size[left] + size[right]
        merges.append((left, right, float(distance[i[k], j[k]]), size[top[a]]))
    return merges


def leaf_order(merges: Sequence[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right under the last merge."""
    stack, out = [n + len(merges) - 1], []
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            left, right = merges[x - n][:2]
            stack += [right, left]
    return out


def bisect(order: Sequence[int], factor: Callable[[list[int], list[int]], float]) -> np.ndarray:
    """Splits the order in halves and gives the left one ``factor`` of the weight, down to single assets."""
    w = np.ones(len(order))
    parts = [list(order)]
    while parts:
        part = parts.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a = factor(left, right)
        w[left] *= a
        w[right] *= 1 - a
        parts += [left, right]
    return w


def _cluster_weights(cov: np.ndarray, c: list[int]) -> tuple[np.ndarray, float]:
    sub = cov[np.ix_(c, c)]
    w = inverse_variance(sub)
    return w, float(w @ sub @ w)


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.round(1 - to_correlation(cov), 5) / 2)
    order = leaf_order(single_linkage(d), len(cov))

    def factor(left: list[int], right: list[int]) -> float:
        a, b = _cluster_weights(cov, left)[1], _cluster_weights(cov, right)[1]
        return 1 - a / (a + b)

    return bisect(order, factor)


def value_at_risk(x: np.ndarray, level: float = 0.05) -> float:
    return float(np.quantile(x, level, method="higher"))


def expected_shortfall(x: np.ndarray, level: float = 0.05) -> float:
    below = x[x < value_at_risk(x, level)]
    return float(below.mean()) if len(below) else float("nan")


def conditional_drawdown(x: np.ndarray, level: float = 0.05) -> float:
    worst = np.maximum.accumulate(np.maximum.accumulate(x) - x)
    above = worst[worst > np.quantile(worst, level, method="higher")]
    return float(above.mean()) if len(above) else float("nan")


ALLOCATIONS = ("minimum_variance", "minimum_standard_deviation", "sharpe_ratio", "equal_weighting", "expected_shortfall", "conditional_drawdown_risk")


def cluster_allocation(cov: np.ndarray, metric: str = "equal_weighting", mu: np.ndarray | None = None, returns: np.ndarray | None = None, level: float = 0.05, clusters: int | None = None) -> np.ndarray:
    """Hierarchical clustering allocation: recursive bisection of the single-linkage order with one of ``ALLOCATIONS``. The number of clusters
    (``gap_clusters``) does not change the order of a single-linkage tree and is accepted for completeness."""
    if metric not in ALLOCATIONS:
        raise ValueError(f"metric is one of {ALLOCATIONS}")
    d = np.sqrt(2 * np.round(1 - to_correlation(cov), 5))
    order = leaf_order(single_linkage(d), len(cov))

    def factor(left: list[int], right: list[int]) -> float:
        (wa, va), (wb, vb) = _cluster_weights(cov, left), _cluster_weights(cov, right)
        by_variance = 1 - va / (va + vb)
        if metric == "minimum_variance":
            return by_variance
        if metric == "minimum_standard_deviation":
            return 1 - math.sqrt(va) / (math.sqrt(va) + math.sqrt(vb))
        if metric == "sharpe_ratio":
            a, b = wa @ mu[left] / math.sqrt(va), wb @ mu[right] / math.sqrt(vb)
            share = a / (a + b) if a + b else -1.0
            return share if 0 <= share <= 1 else by_variance
        if metric == "equal_weighting":
            return 0.5
        risk = expected_shortfall if metric == "expected_shortfall" else conditional_drawdown
        a, b = risk(returns[:, left] @ wa, level), risk(returns[:, right] @ wb, level)
        return 1 - a / (a + b)

    return bisect(order, factor)


def cut_tree(merges: Sequence[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Cluster labels after all but the last k - 1 merges."""
    members = {i: [i] for i in range(n)}
    for m, (a, b, _, _) in enumerate(merges[: n - k]):
        members[n + m] = members.pop(a) + members.pop(b)
    labels = np.zeros(n, dtype=int)
    for c, ids in enumerate(members.values()):
        labels[ids] = c
    return labels


def gap_clusters(returns: np.ndarray, most: int = 10, references: int = 5, seed: int = 0) -> int:
    """The number of clusters with the largest gap between the inertia of random returns and of these."""
    rng = np.random.default_rng(seed)

    def inertia(x: np.ndarray, k: int) -> float:
        corr = np.corrcoef(x, rowvar=False)
        labels = cut_tree(single_linkage(np.sqrt(2 * np.round(1 - corr, 5))), len(corr), k)
        spread = [np.mean(np.linalg.norm(x[:, labels == c][:, :, None] - x[:, labels == c][:, None, :], axis=0)) for c in np.unique(labels)]
        return math.log(max(np.mean(spread), 1e-300))

    most = min(most, returns.shape[1])
    gaps = [np.mean([inertia(rng.random(returns.shape), k) for _ in range(references)]) - inertia(returns, k) for k in range(1, most + 1)]
    return int(np.argmax(gaps)) + 1


def nested_clusters(cov: np.ndarray, mu: np.ndarray | None = None, most: int | None = None, seed: int = 0) -> np.ndarray:
    """Optimal weights inside clusters of correlated assets, then between the clusters."""
    labels = kmeans_select(to_correlation(cov), most or len(cov) // 2, seed=seed)[0]
    groups = [np.flatnonzero(labels == c) for c in np.unique(labels)]
    intra = np.zeros((len(cov), len(groups)))
    for k, g in enumerate(groups):
        intra[g, k] = closed_form(cov[np.ix_(g, g)], None if mu is None else mu[g])
    inter = closed_form(intra.T @ cov @ intra, None if mu is None else intra.T @ mu)
    return intra @ inter


# Critical line.


def critical_line(cov: np.ndarray, mu: np.ndarray, bounds=(0, 1)) -> list[tuple[float, np.ndarray]]:
    """Turning points (risk tolerance, weights) of the efficient frontier from the highest return to the least variance. With a set of free
    assets the weights are linear in the tolerance; the next point is where the first of them reaches a bound or a bounded one
    comes free."""
    n = len(mu)
    low, high = _bounds(bounds, n)
    mu = mu + 1e-10 * np.arange(n)[::-1] * (np.ptp(mu) or 1.0)  # distinct means keep one asset free at the start
    w, left, free = low.copy(), 1 - low.sum(), []
    for i in np.argsort(-mu):
        add = min(left, high[i] - low[i])
        w[i] += add
        left -= add
        if left <= 1e-15:
            free = [int(i)]
            break
    if not free:
        raise ValueError("the bounds allow no weights that sum to 1")

    def line(f: list[int], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of f as a + tolerance x b, with the others as in w."""
        rest = [i for i in range(n) if i not in f]
        k = np.block([[cov[np.ix_(f, f)], np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
        right = np.column_stack([np.append(-cov[np.ix_(f, rest)] @ w[rest], 1 - w[rest].sum()), np.append(mu[f], 0.0)])
        s = np.linalg.solve(k, right)
        return s[:-1, 0], s[:-1, 1]

    points, tolerance = [(math.inf, w.copy())], math.inf
    for _ in range(20 * n):
        best, change = 0.0, None
        if len(free) > 1:
            a, b = line(free, w)
            for i, x, y in zip(free, a, b):
                if abs(y) > 1e-14:
                    limit = high[i] if y < 0 else low[i]
                    t = (limit - x) / y
                    if best < t < tolerance - 1e-12 * max(1, abs(tolerance) if tolerance < math.inf else 1):
                        best, change = t, (i, limit)
        for i in range(n):
            if i not in free:
                f = [*free, i]
                a, b = line(f, w)
                if abs(b[-1]) > 1e-14:
                    t = (w[i] - a[-1]) / b[-1]
                    if best < t < tolerance - 1e-12 * max(1, abs(tolerance) if tolerance < math.inf else 1):
                        best, change = t, (i, None)
        if change is None:
            a, _ = line(free, w)
            w = w.copy()
            w[free] = a
            points.append((0.0, np.clip(w, low, high)))
            return points
        i, limit = change
        tolerance = best
        if limit is None:
            free = [*free, i]
        a, b = line(free, w)
        w = w.copy()
        w[free] = a + tolerance * b
        if limit is not None:
            w[i] = limit
            free = [x for x in free if x != i]
        points.append((tolerance, np.clip(w, low, high)))
    return points


def critical_line_solution(cov: np.ndarray, mu: np.ndarray, solution: str, bounds=(0, 1), points: int = 100):
    """'cla_turning_points' (all weights), 'min_volatility', 'max_sharpe' (risk-free rate 0) or 'efficient_frontier' (return, volatility, weights)."""
    turning = [w for _, w in critical_line(cov, mu, bounds)]
    if solution == "cla_turning_points":
        return turning
    if solution == "min_volatility":
        return min(turning, key=lambda w: w @ cov @ w)
    between = lambda k: [(1 - t) * a + t * b for a, b in zip(turning, turning[1:]) for t in np.linspace(0, 1, k)]
    if solution == "max_sharpe":
        return max(between(200), key=lambda w: (mu @ w) / math.sqrt(w @ cov @ w))
    if solution != "efficient_frontier":
        raise ValueError("unknown solution")
    return [(float(mu @ w), math.sqrt(w @ cov @ w), w) for w in between(max(2, points // max(1, len(turning) - 1)))]


# Views and enumeration.


def entropy_pooling(p: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray | None = None, h: np.ndarray | None = None) -> np.ndarray:
    """The probabilities closest to p in relative entropy with a q = b and g q <= h. Newton on the dual, multipliers of inequalities kept
    non-negative by an active set. ``a`` should include a row of ones with b = 1."""
    active: set[int] = set()
    n_eq, n_in = len(b), 0 if g is None else len(h)
    for _ in range(2 * n_in + 2):
        rows = sorted(active)
        m = np.vstack([a, *([g[rows]] if rows else [])])
        r = np.concatenate([b, h[rows] if rows else np.zeros(0)])
        lam = np.zeros(len(r))
        for _ in range(200):
            q = np.exp(np.clip(np.log(p) - 1 - m.T @ lam, -700, 700))
            gap = m @ q - r
            if np.abs(gap).max() < 1e-12:
                break
            step = np.linalg.lstsq((m * q) @ m.T, gap, rcond=None)[0]
            dual = lambda x: float(np.exp(np.clip(np.log(p) - 1 - m.T @ x, -700, 700)).sum() + r @ x)
            size, now = 1.0, dual(lam)
            while dual(lam + size * step) > now and size > 1e-10:
                size /= 2
            lam = lam + size * step
        drop = [rows[i] for i in range(len(rows)) if lam[n_eq + i] < -1e-12]
        add = [i for i in range(n_in) if i not in active and g[i] @ q > h[i] + 1e-10]
        if not drop and not add:
            return q
        active = (active - set(drop)) | set(add)
    return q


def random_portfolios(distance: np.ndarray, mu: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Rows of (return, w'Dw) and the weights of random portfolios with a distance matrix for risk."""
    rng = np.random.default_rng(seed)
    w = rng.dirichlet(np.ones(len(mu)), n)
    return np.column_stack([w @ mu, np.einsum("ij,jk,ik->i", w, distance, w), w])


def distance_optimum(distance: np.ndarray, mu: np.ndarray, risk_free: float = 0.0) -> np.ndarray:
    """Non-negative weights of the highest excess return over sqrt(w'Dw)."""

    def loss(x: np.ndarray) -> float:
        w = np.abs(x) / max(np.abs(x).sum(), 1e-300)
        return -(w @ mu - risk_free) / math.sqrt(max(w @ distance @ w, 1e-300))

    x, _ = nelder_mead(loss, np.full(len(mu), 1 / len(mu)), steps=400 * len(mu))
    return np.abs(x) / np.abs(x).sum()


def partitions(units: int, assets: int):
    """All ways to put ``units`` into ``assets``."""
    if assets == 1:
        yield (units,)
        return
    for i in range(units + 1):
        for rest in partitions(units - i, assets - 1):
            yield (i, *rest)


def signed_weights(units: int, assets: int) -> np.ndarray:
    """Distinct signed weights whose absolute values sum to 1, in steps of 1 / units."""
    out = {tuple(s * x / units for s, x in zip(signs, p)) for p in partitions(units, assets) for signs in product((1, -1), repeat=assets)}
    return np.array(sorted(out))


def dynamic_optimum(mus: Sequence[np.ndarray], covs: Sequence[np.ndarray], costs: Sequence[np.ndarray], units: int, first: int | None = None) -> tuple[float, np.ndarray]:
    """The path of signed weights over horizons of the highest Sharpe ratio after costs c sqrt(|change|), by enumeration; ``first``: only paths that begin with
    these weights."""
    grid = signed_weights(units, len(mus[0]))
    best, at = -np.inf, None
    starts = range(len(grid)) if first is None else [first]
    for path in product(starts, *[range(len(grid))] * (len(mus) - 1)):
        ret = var = 0.0
        before = np.zeros(len(mus[0]))
        for k, mu, cov, c in zip(path, mus, covs, costs):
            w = grid[k]
            ret += w @ mu - (c * np.sqrt(np.abs(w - before))).sum()
            var += w @ cov @ w
            before = w
        sr = ret / math.sqrt(var) if var > 0 else -np.inf
        if sr > best or at is None:
            best, at = sr, path
    return float(best), grid[list(at)]
