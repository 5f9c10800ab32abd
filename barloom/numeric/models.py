"""Likelihood models of one series: volatility clustering, mixtures, hidden regimes, informed trading, local trend."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from barloom.numeric.optimize import nelder_mead, nelder_mead_many

VOLATILITY_MODELS = ("arch", "garch", "egarch", "garchm", "figarch")
#: Free parameters of each likelihood: a shorter series has no fit.
VOLATILITY_PARAMETERS = {"arch": 3, "garch": 4, "egarch": 4, "garchm": 4, "figarch": 5}
REGIME_PARAMETERS, TREND_PARAMETERS = 7, 3  # of two regimes: start, two transitions, two means, two variances


#: Terms of FIGARCH's infinite memory, for series of every length.
FIGARCH_LAGS = 1000


def _figarch_weights(phi: float, d: float, beta: float) -> list[float]:
    delta, pi = d, [phi - beta + d]
    for k in range(1, FIGARCH_LAGS):
        before, delta = delta, (k - d) / (k + 1) * delta
        pi.append(beta * pi[-1] + delta - phi * before)
    return pi


def conditional_variance(model: str, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The variance path of demeaned returns r for parameters p (without the mean). FIGARCH sums ``FIGARCH_LAGS`` squares; those before
    the series are the exponentially weighted mean of its first 75."""
    n, v0 = len(r), float(r.var()) or 1e-12
    h = np.full(n, v0)
    if model == "arch":
        h[1:] = p[0] + p[1] * r[:-1] ** 2
    elif model in ("garch", "garchm"):
        for t in range(1, n):
            h[t] = p[0] + p[1] * r[t - 1] ** 2 + p[2] * h[t - 1]
    elif model == "egarch":
        log = math.log(v0)
        for t in range(1, n):
            z = r[t - 1] / math.sqrt(h[t - 1])
            log = p[0] + p[1] * (abs(z) - math.sqrt(2 / math.pi)) + p[2] * log
            h[t] = math.exp(min(max(log, -60), 60))
    elif model == "figarch":
        omega, phi, d, beta = p
        pi = np.array(_figarch_weights(phi, d, beta))
        weight = 0.94 ** np.arange(min(n, 75))
        before = float((weight / weight.sum()) @ r[: len(weight)] ** 2) or v0
        beyond = np.append(np.cumsum(pi[::-1])[::-1], 0.0)  # the weight of what lies before the series
        h = omega / max(1 - beta, 1e-6) + before * beyond[np.minimum(np.arange(n), FIGARCH_LAGS)]
        if n > 1:
            h[1:] += np.convolve(r[:-1] ** 2, pi[:n])[: n - 1]
    else:
        raise ValueError(f"model is one of {VOLATILITY_MODELS}")
    return np.maximum(h, 1e-300)


def fit_volatility(returns: np.ndarray, model: str = "garch") -> dict[str, float]:
    """Maximum likelihood with normal errors and a constant mean (garchm is fitted as garch): parameters, ``loglik`` and ``last_variance``."""
    scale = float(np.std(returns)) or 1.0
    x = np.asarray(returns, dtype=float) / scale
    starts = {"arch": [0.7, 0.3], "garch": [0.05, 0.08, 0.87], "garchm": [0.05, 0.08, 0.87], "egarch": [0.0, 0.15, 0.9], "figarch": [0.1, 0.2, 0.4, 0.4]}
    limits = {"arch": [(1e-8, None), (0, 0.9999)], "garch": [(1e-8, None), (0, 1), (0, 0.9999)], "egarch": [(None, None), (None, None), (-0.9999, 0.9999)], "figarch": [(1e-8, None), (0, 1), (0.001, 0.999), (0, 0.999)]}
    limits["garchm"] = limits["garch"]
    names = {"arch": ["omega", "alpha"], "garch": ["omega", "alpha", "beta"], "egarch": ["omega", "alpha", "beta"], "figarch": ["omega", "phi", "d", "beta"]}
    names["garchm"] = names["garch"]
    if model not in VOLATILITY_MODELS:
        raise ValueError(f"model is one of {VOLATILITY_MODELS}")

    def loss(p: np.ndarray) -> float:
        if model in ("garch", "garchm") and p[2] + p[3] >= 0.99999:
            return 1e300
        r = x - p[0]
        h = conditional_variance(model, r, p[1:])
        return 0.5 * float((np.log(2 * math.pi * h) + r * r / h).sum())

    p, v = nelder_mead(loss, [float(x.mean()), *starts[model]], [(None, None), *limits[model]], 600)
    out = dict(zip(["mu", *names[model]], map(float, p)))
    out["mu"] *= scale
    if model != "egarch":
        out["omega"] *= scale**2
    out["loglik"] = -v - len(x) * math.log(scale)
    out["last_variance"] = float(conditional_variance(model, x - p[0], p[1:])[-1]) * scale**2
    return out


# Mixture of two normals from five moments.


def centered_moment(raw: Sequence[float], order: int) -> float:
    """The central moment of an order from raw moments (first to fifth)."""
    m = [1.0, *raw]
    return sum(math.comb(order, j) * (-m[1]) ** j * m[order - j] for j in range(order + 1))


def raw_moments(central: Sequence[float], mean: float) -> list[float]:
    """Raw moments from central ones (first, which is 0, to last)."""
    c = [1.0, *central]
    return [mean, *[sum(math.comb(n, k) * c[k] * mean ** (n - k) for k in range(n + 1)) for n in range(2, len(c))]]


def mixture_moments(mu1: float, mu2: float, s1: float, s2: float, p: float) -> np.ndarray:
    """The first five raw moments."""
    one = lambda u, s: np.array([u, s**2 + u**2, 3 * s**2 * u + u**3, 3 * s**4 + 6 * s**2 * u**2 + u**4, 15 * s**4 * u + 10 * s**2 * u**3 + u**5])
    return p * one(mu1, s1) + (1 - p) * one(mu2, s2)


def _mixture_step(m: Sequence[float], mu2: float, p: float, fifth: bool) -> tuple[float, float, float, float, float] | None:
    """One pass of the fixed point: the other parameters from mu2 and p, then p (and mu2, with the fifth moment) again."""
    if not 0 < p < 1:
        return None
    mu1 = (m[0] - (1 - p) * mu2) / p
    gap = 3 * (1 - p) * (mu2 - mu1)
    if gap == 0:
        return None
    v2 = (m[2] + 2 * p * mu1**3 + (p - 1) * mu2**3 - 3 * mu1 * (m[1] + mu2**2 * (p - 1))) / gap
    v1 = (m[1] - v2 - mu2**2) / p + v2 + mu2**2 - mu1**2
    if v1 < 0 or v2 < 0:
        return None
    if fifth:
        a = 6 * v2**2 + (m[3] - p * (3 * v1**2 + 6 * v1 * mu1**2 + mu1**4)) / (1 - p)
        if 1 - p < 1e-4 or a < 0 or math.sqrt(a) < 3 * v2:
            return None
        mu2 = math.sqrt(math.sqrt(a) - 3 * v2)
        one = 15 * v1**2 * mu1 + 10 * v1 * mu1**3 + mu1**5
        two = 15 * v2**2 * mu2 + 10 * v2 * mu2**3 + mu2**5
        if one == two:
            return None
        p = (m[4] - two) / (one - two)
    else:
        bottom = 3 * (v1**2 - v2**2) + 6 * (v1 * mu1**2 - v2 * mu2**2) + mu1**4 - mu2**4
        if bottom == 0:
            return None
        p = (m[3] - 3 * v2**2 - 6 * v2 * mu2**2 - mu2**4) / bottom
    return (mu1, mu2, math.sqrt(v1), math.sqrt(v2), p) if 0 <= p <= 1 else None


def fit_mixture(moments: Sequence[float], seed: int = 0, epsilon: float = 1e-3, factor: float = 5, fifth: bool = True, steps: int = 1000) -> dict[str, float] | None:
    """One run: for a ladder of starts of mu2 and a random p, the fixed point with the least squared error in five moments."""
    rng = np.random.default_rng(seed)
    target, sd = np.asarray(moments, dtype=float), math.sqrt(max(centered_moment(moments, 2), 0))
    best, error = None, float((target**2).sum())
    for i in range(1, int(1 / epsilon)):
        mu2, p = i * epsilon * factor * sd + moments[0], rng.uniform()
        for _ in range(steps):
            s = _mixture_step(moments, mu2, p, fifth)
            if s is None:
                break
            e = float(((target - mixture_moments(*s)) ** 2).sum())
            if e < error:
                best, error = s, e
            done = abs(p - s[4]) < epsilon
            p, mu2 = s[4], s[1]
            if done:
                break
    return None if best is None else dict(zip(["mu_1", "mu_2", "sigma_1", "sigma_2", "p_1"], best)) | {"error": error}


def most_likely(fits: Sequence[dict[str, float]], resolution: int = 1000) -> dict[str, float]:
    """For each parameter the mode of its kernel density over the runs."""
    out = {}
    for name in ("mu_1", "mu_2", "sigma_1", "sigma_2", "p_1"):
        x = np.array([f[name] for f in fits])
        h = x.std(ddof=1) * len(x) ** -0.2 if len(x) > 1 else 0.0
        if h <= 0:
            out[name] = float(x[0])
            continue
        at = np.linspace(x.min(), x.max(), resolution)
        z = (at[:, None] - x[None]) / h
        out[name] = round(float(at[np.exp(-0.5 * z * z).sum(axis=1).argmax()]), 5)
    return out


def hidden_regimes(x: np.ndarray, states: int = 2, steps: int = 100, seed: int = 0) -> dict[str, np.ndarray]:
    """Gaussian hidden Markov model by expectation-maximisation, and the most likely path (Viterbi): ``mean``, ``variance``, ``transition``, ``path``."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    least = max(1e-3 * float(x.var()), 1e-12)  # a regime of one value would have any likelihood
    var = np.full(states, max(x.var(), least))
    trans = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(trans, 0.9 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    before = -np.inf
    for _ in range(steps):
        b = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * math.pi * var) + 1e-300
        alpha, c = np.zeros((n, states)), np.zeros(n)
        alpha[0] = start * b[0]
        c[0] = alpha[0].sum()
        alpha[0] /= c[0]
        for t in range(1, n):
            alpha[t] = (alpha[t - 1] @ trans) * b[t]
            c[t] = alpha[t].sum()
            alpha[t] /= c[t]
        beta = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / c[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        xi = np.einsum("ti,ij,tj->ij", alpha[:-1], trans, b[1:] * beta[1:] / c[1:, None])
        start, trans = gamma[0], xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(axis=0), 1e-300)
        mean = gamma.T @ x / weight
        var = np.maximum((gamma * (x[:, None] - mean) ** 2).sum(axis=0) / weight, least)
        now = float(np.log(c).sum())
        if now - before < 1e-6:
            break
        before = now
    log_b = -0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * math.pi * var))
    log_t = np.log(trans + 1e-300)
    score, back = np.log(start + 1e-300) + log_b[0], np.zeros((n, states), dtype=int)
    for t in range(1, n):
        step = score[:, None] + log_t
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + log_b[t]
    path = np.zeros(n, dtype=int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return {"mean": mean, "variance": var, "transition": trans, "path": path}


def informed_trading(buys: np.ndarray, sells: np.ndarray, start: Sequence[float] = (0.05, 0.5, 0.5, 0.5, 0.5)) -> float:
    """Probability of informed trading from buy and sell orders: the likelihood weighs alpha + eb against 1 - alpha + es and mu (eb + es)."""

    def loss(p: np.ndarray) -> float:
        alpha, _, mu, eb, es = p
        b, s, o = alpha + eb, 1 - alpha + es, mu * (eb + es)
        all_ = b + s + o
        return -float(buys.sum() * math.log(max(b / all_, 1e-300)) + sells.sum() * math.log(max(s / all_, 1e-300)))

    p, _ = nelder_mead(loss, start, [(0, 1), (0, 1), (0, None), (0, None), (0, None)], 400)
    a, d = p[0], p[1]
    bottom = a * d + (1 - a) * (1 - d)
    return float(a * d / bottom) if bottom else float("nan")


def _trend_losses(z: np.ndarray, alive: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The negative log likelihood of each column of z for its row of logs; the first alive[t] columns have a value in row t."""
    h, q1, q2 = np.ascontiguousarray(np.exp(np.clip(logs, -30, 10)).T)
    total, x0, x1 = np.zeros(len(h)), z[0].copy(), np.zeros(len(h))
    p00, p01, p10, p11 = np.full(len(h), 1e4), np.zeros(len(h)), np.zeros(len(h)), np.full(len(h), 1e4)
    sums, s, e, k0, k1, a = total, *np.empty((5, len(h)))
    for v, m in zip(z, alive.tolist()):
        if m < len(sums):
            sums, s, e, k0, k1, a, x0, x1, p00, p01, p10, p11, h, q1, q2 = (c[:m] for c in (sums, s, e, k0, k1, a, x0, x1, p00, p01, p10, p11, h, q1, q2))
        x0 += x1
        p00 += p10
        np.add(p01, p11, out=p01)
        p00 += p01
        p00 += q1
        p10 += p11
        p11 += q2
        np.add(p00, h, out=s)
        np.subtract(v[:m], x0, out=e)
        np.divide(p00, s, out=k0)
        np.divide(p10, s, out=k1)
        np.multiply(k0, e, out=a)
        x0 += a
        np.multiply(k1, e, out=a)
        x1 += a
        np.multiply(k1, p01, out=a)
        p11 -= a
        np.multiply(k0, p01, out=a)
        p01 -= a
        k1 *= p00
        p10 -= k1
        k0 *= p00
        p00 -= k0
        e *= e
        e /= s
        s *= 2 * math.pi
        np.log(s, out=s)
        s += e
        s *= 0.5
        sums += s
    return total


def local_trends(series: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    """Local linear trends by maximum likelihood, many series at once: variances of measurement, level and slope. Each series has the fit that it has alone."""
    lengths = np.array([len(x) for x in series])
    order = np.argsort(-lengths, kind="stable")  # the series that go on at a time are the first ones
    scale = np.array([float(np.std(series[i])) or 1.0 for i in order])
    z = np.zeros((lengths.max(), len(order)))
    for j, i in enumerate(order):
        z[: lengths[i], j] = np.asarray(series[i], dtype=float) / scale[j]
    ends = np.sort(lengths)

    def losses(lanes: np.ndarray, logs: np.ndarray) -> np.ndarray:
        if len(lanes) == len(order):
            return _trend_losses(z, len(order) - np.searchsorted(ends, np.arange(len(z)), side="right"), logs)
        own = lengths[order[lanes]]
        alive = len(lanes) - np.searchsorted(own[::-1], np.arange(own[0]), side="right")
        return _trend_losses(z[: own[0], lanes], alive, logs)

    with np.errstate(all="ignore"):
        logs, v = nelder_mead_many(losses, len(order), [-2.0, -2.0, -4.0], steps=200)
    fitted = np.exp(np.clip(logs, -30, 10)) * (scale**2)[:, None]
    back = np.argsort(order)
    return {"measurement": fitted[back, 0], "level": fitted[back, 1], "slope": fitted[back, 2], "loglik": (-v - lengths[order] * np.log(scale))[back]}


def local_trend(z: np.ndarray) -> dict[str, float]:
    """Local linear trend by maximum likelihood: variances of measurement, level and slope."""
    return {k: float(v[0]) for k, v in local_trends([z]).items()}


def partial_autocorrelation(acf: Sequence[float]) -> list[float]:
    """Durbin-Levinson: partial autocorrelations of lags 1 .. k from the autocorrelations of lags 1 .. k."""
    out, phi = [], np.zeros(0)
    for k in range(1, len(acf) + 1):
        if k == 1:
            p = acf[0]
        else:
            top = acf[k - 1] - phi @ np.array(acf[k - 2 :: -1][: k - 1])
            bottom = 1 - phi @ np.array(acf[: k - 1])
            p = top / bottom if bottom else float("nan")
        phi = np.append(phi - p * phi[::-1], p)
        out.append(float(p))
    return out
