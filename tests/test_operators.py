"""Joins, sweeps, filters, labels, weights and numerics against brute force and known answers."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import entropy as E
from barloom.functions.special import norm_cdf, phi, phi_inverse
from barloom.joins import asof_join, interval_sums, range_join, sweep
from barloom.numeric import clusters, matrices, models, portfolio
from barloom.numeric.optimize import nelder_mead, quadratic_program
from barloom.numeric.trees import Tree
from barloom.operators import backtest, betsize, breaks, distance, labeling, signals, technical, validation, volatility, weights
from barloom.ordering import Staged, running, with_position

HOUR = 3_600_000_000


def points(spark, rows, names="k long, t long, x double"):
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def rng():
    return random.Random(17)


def test_positions_and_running_sums(spark, rng):
    rows = [(rng.choice([1, 1, 2, None]), rng.randrange(0, 40) * HOUR, float(i)) for i in range(400)]
    df = points(spark, rows)
    pos = {(r.k, r.x): r["_pos"] for r in with_position(df, ["k"], "t", ["x"]).collect()}
    run = {(r.k, r.x): (r.s, r.m, r.b) for r in running(df, ["k"], "t", ["x"], {"s": ("sum", "x"), "m": ("max", "x"), "b": ("last", F.when(F.col("x") % 7 == 0, F.col("x")))}).collect()}
    for k in (1, 2, None):
        s, m, b = 0.0, -1.0, None
        for i, (_, t, x) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            s, m, b = s + x, max(m, x), x if x % 7 == 0 else b
            assert pos[k, x] == i and run[k, x] == (s, m, b)


def test_asof_joins(spark, rng):
    left = [(rng.choice([1, 2, None]), rng.choice([None, *range(50)]), float(i)) for i in range(200)]
    right = [(rng.choice([1, 2]), rng.randrange(50), float(i)) for i in range(60)]
    l = points(spark, [(k, None if t is None else t * HOUR, x) for k, t, x in left])
    r = points(spark, [(k, t * HOUR, v) for k, t, v in right], "k long, at long, v double")
    for forward in (False, True):
        for exact in (False, True):
            got = {x.x: x.v for x in asof_join(l, r, ["k"], "t", "at", ["v"], forward, exact).collect()}
            assert len(got) == len(left)
            for k, t, x in left:
                fit = [(a, v) for kk, a, v in right if t is not None and kk == k and ((a > t if forward else a < t) or (exact and a == t))]
                best = (min if forward else max)((a for a, _ in fit), default=None)
                assert got[x] == max((v for a, v in fit if a == best), default=None)


def test_sweeps_and_range_joins(spark, rng):
    at = [(rng.choice([1, 2]), rng.randrange(100), float(i)) for i in range(150)]
    spans = [(rng.choice([1, 2]), a, a + rng.randrange(0, 30), float(i)) for i, a in enumerate(rng.randrange(90) for _ in range(80))]
    p = points(spark, [(k, t * HOUR, x) for k, t, x in at])
    i = points(spark, [(k, a * HOUR, b * HOUR, v) for k, a, b, v in spans], "k long, a long, b long, v double")
    for closed in (True, False):
        got = {r.x: (r.s, r.n) for r in sweep(p, i, ["k"], "t", "a", "b", {"s": F.col("v"), "n": F.lit(1)}, closed).collect()}
        for k, t, x in at:
            live = [v for kk, a, b, v in spans if kk == k and a <= t and (t <= b if closed else t < b)]
            assert got[x][1] == len(live) and abs(got[x][0] - sum(live)) < 1e-6
    sums = {(r.k, r.a, r.b): r.s for r in interval_sums(p, i, ["k"], "t", "a", "b", {"s": F.col("x")}).collect()}
    pairs = range_join(p, i, ["k"], "t", "a", "b").count()
    for k, a, b, _ in spans:
        assert abs(sums[k, a * HOUR, b * HOUR] - sum(x for kk, t, x in at if kk == k and a <= t <= b)) < 1e-6
    assert pairs == sum(1 for k, a, b, _ in spans for kk, t, _ in at if k == kk and a <= t <= b)


def test_cusum_fixture(spark):
    df = points(spark, [(1, i, x) for i, x in enumerate([0.0, 0.6, 1.2, 1.3, 0.2, -0.2])])
    assert [(r.t, r.direction) for r in signals.cusum_events(df, ["k"], "t", "x", 1.0).orderBy("t").collect()] == [(2, 1), (4, -1)]


@pytest.mark.parametrize("cell, block", [(6 * HOUR, 50_000), (7, 11)])
def test_ewm_matches_pandas(spark, rng, cell, block):
    x = [rng.gauss(0, 1) + 1000 if rng.random() > 0.1 else None for _ in range(60)]
    y = [None, None, float("nan"), 2.0, 5.0]
    df = points(spark, [(1, i, v) for i, v in enumerate(x)] + [(None, i, v) for i, v in enumerate(y)])
    for span, adjust in ((5, True), (20, True), (5, False)):
        out = volatility.ewm(df, ["k"], "t", "x", span=span, adjust=adjust, cell_us=cell, block_rows=block).orderBy("k", "t").toPandas()
        for k, values in ((1, x), (None, y)):
            rows = out[out.k == 1] if k else out[out.k.isna()]
            e = pd.Series(values, dtype=float).ewm(span=span, adjust=adjust)
            np.testing.assert_allclose(rows.ewm_mean.to_numpy(float), e.mean().to_numpy(), atol=1e-9)
            np.testing.assert_allclose(rows.ewm_std.to_numpy(float)[2:], e.std().to_numpy()[2:], atol=1e-8)
    assert volatility.ewm(df.where("1 = 0"), ["k"], "t", "x", span=5).count() == 0


@pytest.mark.parametrize("cell, block", [(6 * HOUR, 50_000), (9, 13)])
def test_strength_indicators_match_recurrences(spark, rng, cell, block):
    x = [100.0]
    for _ in range(80):
        x.append(x[-1] + rng.gauss(0, 1))
    df = points(spark, [(k, i, v) for k in (1, 2) for i, v in enumerate(x)])
    d = pd.Series(x).diff()
    mean = lambda s, a: s.ewm(alpha=a, adjust=False).mean()
    up, down = mean(d.clip(lower=0).fillna(0), 1 / 14), mean((-d).clip(lower=0).fillna(0), 1 / 14)
    want = (100 - 100 / (1 + up / down)).where(np.arange(81) >= 13)
    got = volatility.rsi(df, ["k"], "t", "x", cell_us=cell, block_rows=block).where("k = 2").orderBy("t").toPandas().rsi
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), atol=1e-9)
    twice = lambda s: mean(mean(s[1:], 2 / 26), 2 / 14)
    got = technical.true_strength(df, ["k"], "t", "x", cell_us=cell, block_rows=block).where("k = 1").orderBy("t").toPandas().tsi
    np.testing.assert_allclose(got.to_numpy(float)[1:], (100 * twice(d) / twice(d.abs())).to_numpy(), atol=1e-9)


def test_reach_beyond_the_halo_is_refused(spark):
    s = Staged.over(points(spark, [(1, i, 1.0) for i in range(9)]), ["k"], "t", halo=3)
    with pytest.raises(ValueError):
        s.lag("x", 4)
    with pytest.raises(ValueError):
        volatility.fixed_width_difference(s, "x", 0.4, 1e-2)
    assert len(volatility.fixed_width_weights(0.1, 1e-6)) > 10_000
    with pytest.raises(ValueError):
        volatility.fixed_width_weights(-0.5, 1e-6)


def test_rolling_blocks_match_pandas(spark, rng):
    x = [rng.gauss(0, 1) for _ in range(500)]
    df = points(spark, [(1, i, v) for i, v in enumerate(x)])
    from barloom.ordering import block_window, blocked

    s = Staged(blocked(df, ["k"], "t", [], 24, block_rows=100, cell_us=37), block_window(["k"]))
    out = volatility.rolling_moments(s, "x", 20).rows("t", "roll_mean", "roll_std", "roll_skew", "roll_kurt").orderBy("t").toPandas()
    r = pd.Series(x).rolling(20)
    for c, want in (("roll_mean", r.mean()), ("roll_std", r.std()), ("roll_skew", r.skew()), ("roll_kurt", r.kurt())):
        np.testing.assert_allclose(out[c].to_numpy(float), want.to_numpy(), atol=1e-8)


def test_dynamic_z_score():
    m = signals.DynamicZMachine(3, 2.0, 0.5)
    assert [m.signal(x) for x in (1, 1.1, 0.9, 1.0, 5.0, 1.0, -9.0)] == [0, 0, 0, 0, 1, 0, -1]


def test_etf_trick_of_one_security_is_its_price(spark):
    prices = [10.0, 11.0, 12.0, 9.0, 9.5]
    rows = [("b", i, "s", p, p, 1.0, 0.0, 1.0) for i, p in enumerate(prices)]
    out = signals.etf_trick(spark.createDataFrame(rows, "basket string, ts long, security string, open double, close double, alloc double, cost double, rate double"), "basket").orderBy("ts").collect()
    assert out[0].value == 1.0 and len(out) == 5 and all(math.isfinite(r.value) for r in out)


def test_kalman_tracks_a_line():
    z = np.arange(50) * 2.0 + 3
    filtered, smooth = signals.kalman_smooth(z)
    assert abs(smooth[25, 0] - z[25]) < 0.1 and abs(filtered[-1, 1] - 2) < 0.1
    m = signals.LagSmoother(4)
    out = m.feed({"_ts": np.arange(50), "_x": z})
    tail = m.finish()
    assert out["_ts"].tolist() + tail["_ts"].tolist() == list(range(50)) and abs(tail["slope"][-1] - 2) < 0.1


def test_triple_barrier_and_weights(spark):
    path = [100, 101, 103, 99, 95, 100, 100]
    prices = points(spark, [(1, i * HOUR, float(p)) for i, p in enumerate(path)], "k long, ts long, close double")
    ev = spark.createDataFrame([(1, 0, 4 * HOUR, 0.02, 1.0, 1.0, 1.0), (1, HOUR, None, 0.05, 1.0, 1.0, 1.0), (1, 2 * HOUR, 3 * HOUR, 0.5, -1.0, 1.0, 1.0)], "k long, t0 long, t1 long, trgt double, side double, pt double, sl double")
    out = {r.t0: r.touch for r in labeling.triple_barrier(prices, ev, ["k"]).collect()}
    assert out == {0: 2 * HOUR, HOUR: 4 * HOUR, 2 * HOUR: 3 * HOUR}
    labels = spark.createDataFrame([(1, 0, 2 * HOUR), (1, 2 * HOUR, 3 * HOUR)], "k long, t0 long, t1 long")
    assert [r.n_labels for r in weights.concurrency(prices, labels, ["k"]).orderBy("ts").collect()] == [1, 1, 2, 1, 0, 0, 0]
    u = {r.t0: r.uniqueness for r in weights.average_uniqueness(prices, labels, ["k"]).collect()}
    assert abs(u[0] - 2.5 / 3) < 1e-12 and abs(u[2 * HOUR] - 0.75) < 1e-12
    w = weights.weights_by_return(prices, labels, ["k"]).collect()
    assert abs(sum(r.weight for r in w) - 2) < 1e-9


@pytest.mark.parametrize("cells", [(24 * HOUR, HOUR), (HOUR,), (40 * HOUR, 5 * HOUR, HOUR // 2)])
def test_first_touches_match_brute_force(spark, cells):
    rng = np.random.default_rng(4)
    path = 100 * np.exp(np.cumsum(rng.standard_normal(300) * 0.01))
    ts = np.sort(rng.choice(300 * HOUR, 300, replace=False))
    prices = spark.createDataFrame([(k, int(t), float(p)) for k in (1, None) for t, p in zip(ts, path)], "k long, ts long, close double")
    ev = []
    for i in range(60):
        t0 = int(rng.integers(0, 310 * HOUR))
        t1 = None if i % 4 == 0 else t0 + int(rng.integers(0, 90 * HOUR))
        ev.append((1 if i % 2 else None, t0, t1, float(rng.uniform(0.001, 0.05)), float(rng.choice([1.0, -1.0])), float(rng.choice([0.0, 1.0, 2.0])), float(rng.choice([0.0, 1.0, 2.0]))))
    ev.append((2, 0, None, 0.01, 1.0, 1.0, 1.0))
    out = labeling.triple_barrier(prices, spark.createDataFrame(ev, "k long, t0 long, t1 long, trgt double, side double, pt double, sl double"), ["k"], cells_us=cells).collect()
    got = {(r.k, r.t0): r.touch for r in out}
    assert len(out) == len(ev)
    for k, t0, t1, trgt, side, pt, sl in ev:
        times = [t1] if t1 is not None else []
        inside = [] if k == 2 else [(t, p) for t, p in zip(ts, path) if t0 <= t <= (t1 if t1 is not None else ts[-1])]
        if inside:
            r = [(t, (p / inside[0][1] - 1) * side) for t, p in inside]
            times += [int(t) for t, x in r if (pt > 0 and x > pt * trgt) or (sl > 0 and x < -sl * trgt)][:1]
        assert got[k, t0] == (min(times) if times else None)


def test_sequential_bootstrap_prefers_unique_labels():
    b = weights.Bootstrap(np.array([0, 2, 4]), np.array([2, 3, 5]), np.arange(6))
    m = b.matrix()
    assert m.sum(axis=0).tolist() == [3, 2, 2]
    c = m.sum(axis=1)
    want = (m.T / c)[m.T > 0].mean()
    assert abs(b.average_uniqueness() - want) < 1e-12
    count = m[:, 1].copy()
    p = b.probabilities(count)
    u = np.array([np.mean(1 / (1 + count[m[:, j] > 0])) for j in range(3)])
    np.testing.assert_allclose(p, u / u.sum())
    assert b.draw(5, seed=1, warmup=[1])[0] == 1 and len(b.draw(7, seed=2)) == 7


def test_purged_folds_never_overlap(spark, rng):
    rows = [(1, t * HOUR, (t + rng.randrange(1, 6)) * HOUR) for t in range(0, 120, 2)]
    df = spark.createDataFrame(rows, "k long, t0 long, t1 long")
    out = validation.purged_folds(df, ["k"], 4, 0.05, strict=True).collect()
    for s in range(4):
        test = [(r.t0, r.t1) for r in out if r.split == s and r.role == "test"]
        train = [(r.t0, r.t1) for r in out if r.split == s and r.role == "train"]
        a, b = min(t for t, _ in test), max(t for _, t in test)
        assert len(test) == 15 and train and all(e < a or f > b for f, e in train)
    paths = validation.path_assignment(4, 2)
    assert validation.backtest_paths(4, 2) == 3 == len({p for p, *_ in paths}) and len(paths) == 12


def test_purge_matches_brute_force(spark, rng):
    spans = lambda n, most: [(rng.choice([1, 1, None]), a, a + rng.randrange(0, most) * HOUR) for a in (rng.randrange(0, 900) * HOUR for _ in range(n))]
    train, tests = spans(150, 40) + [(1, 5, None), (2, 1, 9)], spans(8, 60) + [(1, 500 * HOUR, 480 * HOUR), (1, None, 5)]
    out = validation.purge(spark.createDataFrame(train, "k long, t0 long, t1 long"), spark.createDataFrame(tests, "k long, start long, end long"), ["k"])
    hit = lambda t: any(s is not None and k == t[0] and t[1] <= max(s, e) and t[2] is not None and t[2] >= min(s, e) for k, s, e in tests)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(t) for t in train if not hit(t))


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -3.0, -0.5, 0.0, 1.0, 2.5, 7.2, 50.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf(F.col("x")).alias("p")).collect()]
    np.testing.assert_allclose(got, [phi(x) for x in xs], atol=1e-14)
    assert all(abs(phi(phi_inverse(p)) - p) < 1e-12 for p in (1e-6, 0.025, 0.5, 0.8, 0.999))


def test_entropies():
    assert abs(E.shannon("aab") - 0.9182958) < 1e-6 and E.plug_in("aab") == 0
    assert E.lempel_ziv("abab") == 3 / 4 and E.lempel_ziv("aaaa") == 0.5
    assert E.match_length("abcabc", 3, 3) == 4 and E.match_length("abcd", 2, 2) == 1
    r = random.Random(1)
    assert E.kontoyiannis("ab" * 20) < E.kontoyiannis("".join(r.choice("abcd") for _ in range(40)))
    assert E.kontoyiannis("a") == 0 and math.isnan(E.shannon(""))


def test_distances_and_trees(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((200, 3))
    x[:, 1] = x[:, 0] + 0.01 * x[:, 1]
    panel = spark.createDataFrame([(d, a, float(x[d, a])) for d in range(200) for a in range(3)], "d int, a int, x double")
    info = {(i.a, i.b): i for i in distance.information(panel, "d", "a", "x").collect()}
    assert info[0, 1].vi < info[0, 2].vi and info[0, 1].mi_share > info[0, 2].mi_share
    js = {(i.a, i.b): i.distance for i in distance.jensen_shannon(panel, "d", "a", "x").collect()}
    assert 0 <= js[0, 1] < 1
    tree = distance.spanning_tree([(1, "a", "b"), (2, "b", "c"), (3, "a", "c"), (4, "c", "d")])
    assert [w for w, *_ in tree] == [1, 2, 4] and distance.tree_path(tree, "a", "d") == (7, ["a", "b", "c", "d"])
    assert distance.subdominant_ultrametric(tree, list("abcd")).loc["a", "d"] == 4


def test_sadf_matches_direct_regressions():
    r = np.random.default_rng(3)
    y = np.cumsum(r.standard_normal(60))
    got = breaks.sadf_values(y, 0, 60, "linear", [1], True, 20)
    x, z, lost = breaks.sadf_design(y, "linear", [1], True)
    for end in (30, 45, 59):
        best = -np.inf
        e = end - lost + 1
        for s in range(0, e - 20 + 1):
            a, b = x[s:e], z[s:e]
            inv = np.linalg.inv(a.T @ a)
            beta = inv @ a.T @ b
            err = b - a @ beta
            best = max(best, beta[0] / math.sqrt(err @ err / (len(b) - a.shape[1]) * inv[0, 0]))
        assert abs(got[end] - best) < 1e-6
    assert np.isnan(got[:20]).all()


def test_bet_sizes(spark):
    assert abs(betsize.calibrate(10, 0.95) - 100 * (0.95**-2 - 1)) < 1e-12
    df = spark.createDataFrame([(25.0, 55, 60.0, 75.5)], "pos double, max_pos int, m_p double, f double")
    r = betsize.dynamic_size(df.withColumn("pos", F.col("pos").cast("int"))).first()
    w = betsize.calibrate(10, 0.95)
    assert abs(r.bet_size - 15.5 / math.sqrt(w + 15.5**2)) < 1e-12 and r.t_pos == int(r.bet_size * 55) and r.l_p < 75.5
    same = betsize.dynamic_size(spark.createDataFrame([(0, 10, 5.0, 5.0)], "pos int, max_pos int, m_p double, f double")).first()
    assert same.l_p is None
    with pytest.raises(ValueError):
        betsize.calibrate(3, 0.5, "power")


def test_concentration(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (2, 1.0)], "k int, r double")
    out = {r.k: r.h for r in df.groupBy("k").agg(backtest.concentration(F.col("r")).alias("h")).collect()}
    assert abs(out[1] - 0.0625) < 1e-12 and out[2] is None


def test_optimisers():
    x, v = nelder_mead(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2, [0, 0])
    assert np.allclose(x, [1, -2], atol=1e-4) and v < 1e-7
    x, _ = nelder_mead(lambda p: (p[0] - 5) ** 2, [0.5], [(0, 1)])
    assert abs(x[0] - 1) < 1e-6
    q = quadratic_program(np.diag([1.0, 2.0, 4.0]), np.zeros(3), np.ones((1, 3)), np.ones(1), np.zeros(3), np.ones(3))
    assert np.allclose(q, np.array([4, 2, 1]) / 7, atol=1e-8)
    assert quadratic_program(np.eye(2), np.zeros(2), np.ones((1, 2)), np.array([5.0]), np.zeros(2), np.ones(2)) is None


def test_portfolios():
    r = np.random.default_rng(1)
    mu, cov = matrices.true_market(3, 3, 0.5, r)
    mu = np.abs(mu)
    for w in (portfolio.inverse_variance(cov), portfolio.min_volatility(cov), portfolio.hierarchical_risk_parity(cov), portfolio.nested_clusters(cov), portfolio.max_sharpe(cov, mu, 0.0)):
        assert abs(w.sum() - 1) < 1e-6
    free = portfolio.min_volatility(cov, (-5, 5))
    assert np.allclose(free, portfolio.closed_form(cov), atol=1e-5)
    turning = portfolio.critical_line(cov, mu)
    assert all(abs(w.sum() - 1) < 1e-8 and (w > -1e-9).all() for _, w in turning)
    assert [t for t, _ in turning] == sorted((t for t, _ in turning), reverse=True)
    least, best = portfolio.critical_line_solution(cov, mu, "min_volatility"), portfolio.min_volatility(cov)
    assert abs(least @ cov @ least - best @ cov @ best) < 1e-8
    for t in (0.3, 0.6):  # points on the line are as good as the quadratic program's
        target = (1 - t) * float(mu @ least) + t * float(mu.max())
        w = portfolio.efficient_risk(cov, mu, target)
        on = [x for x in portfolio.critical_line_solution(cov, mu, "efficient_frontier", points=400) if x[0] >= target - 1e-9]
        assert min(v for _, v, _ in on) >= math.sqrt(w @ cov @ w) - 1e-4
    sharpe = lambda w: mu @ w / math.sqrt(w @ cov @ w)
    assert sharpe(portfolio.max_sharpe(cov, mu, 0.0)) >= sharpe(portfolio.critical_line_solution(cov, mu, "max_sharpe")) - 1e-4
    ret = r.multivariate_normal(mu / 252, cov / 252, 400)
    for metric in portfolio.ALLOCATIONS:
        w = portfolio.cluster_allocation(cov, metric, mu, ret)
        assert abs(w.sum() - 1) < 1e-9
    assert 1 <= portfolio.gap_clusters(ret, 4) <= 4
    q = portfolio.entropy_pooling(np.full(4, 0.25), np.array([np.ones(4), [1, 2, 3, 4.0]]), np.array([1, 3.0]))
    assert abs(q.sum() - 1) < 1e-9 and abs(q @ [1, 2, 3, 4] - 3) < 1e-9
    q = portfolio.entropy_pooling(np.full(4, 0.25), np.ones((1, 4)), np.ones(1), np.array([[1, 2, 3, 4.0]]), np.array([2.0]))
    assert abs(q @ [1, 2, 3, 4] - 2) < 1e-8
    sr, path = portfolio.dynamic_optimum([np.array([0.1, 0.0])] * 2, [np.eye(2) * 0.04] * 2, [np.zeros(2)] * 2, 2)
    assert np.abs(path).sum(axis=1).tolist() == [1, 1] and sr > 0


def test_linkage_and_clusters():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0.0]])
    m = portfolio.single_linkage(d)
    assert [(a, b, w) for a, b, w, _ in m] == [(0, 1, 1), (2, 3, 2), (4, 5, 3)] and portfolio.leaf_order(m, 4) == [0, 1, 2, 3]
    assert len(set(portfolio.cut_tree(m, 4, 2))) == 2
    labels, s = clusters.kmeans_select(matrices.block_correlation(3, 4, 0.9), 6)
    assert len(set(labels)) == 3 and all(len(set(labels[i * 4 : i * 4 + 4])) == 1 for i in range(3)) and s.min() > 0.5
    assert len(clusters.kmeans_refined(matrices.random_block_correlation(12, 3, 2, np.random.default_rng(0)))[0]) == 12


def test_denoising():
    r = np.random.default_rng(0)
    cov = np.cov(r.standard_normal((1000, 100)), rowvar=False)
    edge, var = matrices.noise_edge(matrices.eigen(matrices.to_correlation(cov))[0], 10)
    assert 1.5 < edge < 2.0 and 0.9 < var <= 1
    corr = matrices.to_correlation(cov)
    d = matrices.denoise(corr, 2)
    assert np.allclose(np.diag(d), 1) and np.allclose(d, d.T)
    assert np.allclose(np.diag(matrices.shrink_noise(corr, 2)), 1) and np.allclose(np.diag(matrices.detone(corr)), 1)


def test_likelihood_models():
    r = np.random.default_rng(5)
    h, x = 1e-4, []
    for _ in range(1500):
        h = 5e-6 + 0.1 * (x[-1] ** 2 if x else 1e-4) + 0.85 * h
        x.append(math.sqrt(h) * r.standard_normal())
    fit = models.fit_volatility(np.array(x), "garch")
    assert 0.02 < fit["alpha"] < 0.25 and 0.6 < fit["beta"] < 0.97
    assert fit["loglik"] >= models.fit_volatility(np.array(x), "arch")["loglik"] - 1
    z = np.concatenate([r.normal(-1, 0.3, 200), r.normal(2, 0.3, 200)])
    out = models.hidden_regimes(z)
    assert abs(sorted(out["mean"])[0] + 1) < 0.1 and len(set(out["path"][:190])) == 1
    target = models.mixture_moments(-2, 1, 2, 1, 0.1)
    central = [0.0] + [models.centered_moment(target, k) for k in (2, 3, 4, 5)]
    assert np.allclose(models.raw_moments(central, target[0]), target)
    f = models.fit_mixture(list(target), 3, fifth=False)
    assert abs(f["mu_1"] + 2) < 0.2 and abs(f["mu_2"] - 1) < 0.1 and abs(f["p_1"] - 0.1) < 0.05
    assert models.most_likely([f, f])["mu_1"] == f["mu_1"]
    assert 0 <= models.informed_trading(np.array([5.0, 9]), np.array([4.0, 2])) <= 1
    assert models.local_trend(np.arange(60) + r.standard_normal(60))["measurement"] > 0.1
    assert np.allclose(models.partial_autocorrelation([0.5, 0.25, 0.125]), [0.5, 0, 0])


def test_tree():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    assert ((Tree(4).fit(x, y).predict(x) > 0.5) == y).mean() > 0.95


def test_tail_sets_and_rare_labels(spark):
    rows = [(1, f"a{i:02d}", float(i)) for i in range(20)] + [(1, "none", None)]
    out = labeling.tail_sets(spark.createDataFrame(rows, "d int, a string, x double"), "d", "a", "x")
    m = labeling.tail_members(out, "d", "a").first()
    assert m.positive == ["a18", "a19"] and m.negative == ["a00", "a01"]
    df = spark.createDataFrame([(b,) for b in [0] * 60 + [1] * 39 + [-1]], "bin int")
    assert labeling.drop_rare_labels(df).select("bin").distinct().count() == 2


def test_moments_match_pandas(spark, rng):
    from barloom.operators.portfolio import moments

    rows = [(d, a, rng.gauss(0.1, 1)) for d in range(60) for a in "abcd" if rng.random() < 0.8]
    names, mu, cov = moments(spark.createDataFrame(rows, "d int, a string, ret double"), "d", "a")
    wide = pd.DataFrame(rows, columns=["d", "a", "r"]).pivot(index="d", columns="a", values="r")
    assert names == list("abcd")
    np.testing.assert_allclose(mu, wide.mean())
    np.testing.assert_allclose(cov, wide.cov())
    assert moments(spark.createDataFrame([], "d int, a string, ret double"), "d", "a")[0] == []


def test_exact_quantiles(spark, rng):
    from barloom.functions.selection import exact_quantiles, quantile_list

    xs = [round(rng.gauss(0, 100), 3) for _ in range(501)]
    df = spark.createDataFrame([(1, x) for x in xs] + [(2, 5.0), (2, None)], "k long, x double")
    qs = [0.0, 0.05, 0.333, 0.5, 1.0]
    got = {(r.k, r.i): r.value for r in exact_quantiles(df, ["k"], "x", qs).collect()}
    high = {(r.k, r.i): r.value for r in exact_quantiles(df, ["k"], "x", qs, higher=True).collect()}
    for i, q in enumerate(qs):
        assert abs(got[1, i] - np.quantile(xs, q)) < 1e-9 and high[1, i] == np.quantile(xs, q, method="higher")
        assert got[2, i] == 5.0
    np.testing.assert_allclose(quantile_list(df.where("k = 1"), "x", qs), np.quantile(xs, qs))


def test_value_at_risk(spark, rng):
    xs = [rng.gauss(0, 1) for _ in range(200)]
    out = backtest.value_at_risk(spark.createDataFrame([(1, x) for x in xs] + [(None, 1.0)], "k long, r double"), ["k"], "r")
    got = {r.k: r for r in out.collect()}
    assert got[1]["var"] == portfolio.value_at_risk(np.array(xs)) and abs(got[1].expected_shortfall - portfolio.expected_shortfall(np.array(xs))) < 1e-12
    assert got[None]["var"] == 1.0 and got[None].expected_shortfall is None


def test_fills(spark, rng):
    from barloom.functions import frames

    rows = [(rng.choice([1, 2]), t, None if rng.random() < 0.6 else float(rng.randrange(4))) for t in range(200)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    got = {(r.k, r.t): r.x for r in frames.fill_forward(df, ["k"], "t", ["x"], cell_us=7).collect()}
    back = {(r.k, r.t): r.x for r in frames.fill_backward(df, ["k"], "t", ["x"], cell_us=7).collect()}
    zero = {(r.k, r.t): r.x for r in frames.zeros_to_previous(df, ["k"], "t", "x", cell_us=7).collect()}
    for k in (1, 2):
        s = pd.Series({t: x for kk, t, x in rows if kk == k}, dtype=float)
        for t in s.index:
            same = lambda a, b: (a is None and pd.isna(b)) or a == b
            assert same(got[k, t], s.ffill()[t]) and same(back[k, t], s.bfill()[t]) and same(zero[k, t], s.replace(0, np.nan).ffill()[t])
    twice = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (1, None, 9.0)], "k long, o long, x double")
    assert frames.keep_one(twice, ["k"], "o", last=True).first().x == 5.0 and frames.keep_one(twice, ["k"], "o").first().x == 9.0


def test_technical_and_differences(spark, rng):
    from barloom.operators import technical

    x = np.cumsum([rng.gauss(0, 1) for _ in range(120)]) + 50
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, t long, x double")
    out = technical.expanding_difference(df, ["k"], "t", "x", 0.4, 0.2).orderBy("t").toPandas()
    w = volatility.frac_diff_weights(0.4, 120)
    assert 0 < len(out) < 120
    for t, v in zip(out.t, out.frac_diff):
        assert abs(v - w[: t + 1] @ x[t::-1]) < 1e-8
    found = {round(r.d, 1): r for r in technical.difference_search(df, ["k"], "t", "x").collect()}
    assert found[1.0].adf < found[0.0].adf and abs(found[0.0]["corr"] - 1) < 1e-9
    assert all(abs(r.tsi) <= 100 for r in technical.true_strength(df, ["k"], "t", "x").where("tsi is not null").collect())


def test_sharpe_optimum_beats_equal_weights():
    r = np.random.default_rng(4).normal([0.001, 0.0008, -0.001], [0.01, 0.01, 0.02], (500, 3))
    w, z = backtest.psr_optimum(r)

    def plain(w):
        x = r @ w
        d = (x - x.mean()) / x.std()
        sr = x.mean() / x.std()
        return sr / math.sqrt((1 - sr * (d**3).mean() + sr**2 * ((d**4).mean() - 1) / 4) / (len(x) - 1))

    grid = max(plain(np.array([a, c, 1 - a - c])) for a in np.linspace(0, 1, 41) for c in np.linspace(0, 1 - a, 41))
    assert abs(w.sum() - 1) < 1e-9 and abs(plain(w) - z) < 1e-9 and z > grid - 1e-3
    (n, mean, std), = backtest.maximum_sharpe_errors([10], 20)
    assert n == 10 and abs(mean) < 0.2 and std < 0.2


def test_prices_of_options(spark):
    from barloom.operators import pricing
    from barloom.operators.simulate import MonteCarlo

    m = MonteCarlo(spark, 0.05, 100.0, 1.0, 0.2, paths=4000, steps=20, seed=1)
    paths = m.geometric().cache()
    d1 = (0.05 + 0.02) / 0.2
    call = 100 * phi(d1) - 100 * math.exp(-0.05) * phi(d1 - 0.2)
    got, put = pricing.european(paths, 100.0, 0.05, 1.0).first(), pricing.european(paths, 100.0, 0.05, 1.0, "put").first()
    assert abs(got.price - call) < 4 * got.error
    assert abs(pricing.parity_gap(got.price, put.price, 100.0, 100.0, 0.05, 1.0)) < 1.5
    american = pricing.american(paths, 100.0, 0.05, 1.0, "put").first()
    assert put.price - 3 * put.error < american.price < 10
    up, no = pricing.barrier(paths, 100.0, 120.0, 0.05, 1.0, effect="in").first().price, pricing.barrier(paths, 100.0, 120.0, 0.05, 1.0).first().price
    assert abs(up + no - got.price) < 1e-9
    assert pricing.asian(paths, 100.0, 0.05, 1.0, average="geometric").first().price <= pricing.asian(paths, 100.0, 0.05, 1.0).first().price
    assert abs(pricing.futures(paths).first().price - pricing.forward(100.0, 0.05, 0.0, 1.0)) < 2
    assert sorted(map(str, m.geometric().collect())) == sorted(map(str, paths.collect()))  # the same seed, the same paths
    with pytest.raises(ValueError):
        m.square_root(0.1, 0.01, 0.5)
    paths.unpersist()


def test_bagging_and_effects(spark):
    from barloom.operators import ml

    x, y, names = ml.test_features(200, 6, 2, 1, seed=1)
    rows = [(i, i + 3, float(y[i]), *map(float, x[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "t0 long, t1 long, label double, " + ", ".join(f"{n} double" for n in names))
    out, score = ml.sequential_bagging(df, names, "label", estimators=12, depth=4)
    assert score > 0.7 and out.count() == 200
    again = ml.sequential_bagging(df, names, "label", estimators=12, depth=4)[1]
    assert again == score
    with pytest.raises(ValueError):
        ml.sequential_bagging(df, names, "label", max_rows=10)
    r = np.random.default_rng(0)
    c = r.standard_normal(2000)
    t = 0.7 * c + r.standard_normal(2000)
    o = 1.5 * t - c + r.standard_normal(2000)
    e = ml.double_ml(spark.createDataFrame([(float(a), float(b), float(d), i % 4) for i, (a, b, d) in enumerate(zip(o, t, c))], "o double, t double, c double, f int"), "o", "t", ["c"], "f")
    assert abs(e["effect"] - 1.5) < 4 * e["error"] < 0.5
    shuffled = ml.shuffled(df.select("t0", "label"), "label").collect()
    assert len(shuffled) == 200 and sum(a.label for a in shuffled) == y.sum() and [a.label for a in sorted(shuffled, key=lambda r: r.t0)] != list(y)


@pytest.mark.parametrize("name", ["volatility_arch", "hidden_regimes"])
def test_short_series_have_a_row(spark, folder, name):
    import __spark_entry__ as entry
    from barloom.plans.inputs import daily

    out = entry.queries()[name](spark, folder).toPandas()
    all_ = {r.instrument for r in daily(spark, folder).select("instrument").distinct().collect()}
    assert set(out.instrument) == all_


def test_short_series_are_fitted():
    r = np.random.default_rng(2)
    for name, k in models.VOLATILITY_PARAMETERS.items():
        assert all(map(math.isfinite, models.fit_volatility(0.01 * r.standard_normal(k), name).values()))
    assert np.isfinite(models.hidden_regimes(r.standard_normal(models.REGIME_PARAMETERS))["mean"]).all()
    assert math.isfinite(models.local_trend(r.standard_normal(models.TREND_PARAMETERS))["loglik"])


@pytest.mark.parametrize("cell", [7, 1000])
def test_label_uniqueness_equals_the_indicator_matrix(spark, cell):
    r = np.random.default_rng(6)
    points = [(k, int(t)) for k in (1, 2) for t in r.integers(0, 200, 150)] + [(1, 50), (3, 5), (None, 5), (1, None)]
    starts = r.integers(-5, 180, 60)
    rows = [(int(1 + i % 2), int(a), int(a + b)) for i, (a, b) in enumerate(zip(starts, r.integers(0, 40, 60)))]
    rows += rows[:3] + [(4, 1, 9), (4, 9, 12), (1, 30, 29), (None, 1, 5), (2, 10, None)]
    p, l = spark.createDataFrame(points, "k long, ts long"), spark.createDataFrame(rows, "k long, t0 long, t1 long")
    ones = weights.indicator_rows(p, l.where("t1 >= t0"), ["k"]).toPandas()
    ones["u"] = 1 / ones.groupby(["k", "ts"]).t0.transform("size")
    g = ones.groupby(["k", "t0", "t1"])
    want = pd.DataFrame({"uniqueness": g.u.mean(), "n_labels": g.size() / g.ts.nunique()}).reset_index()
    got = weights.label_uniqueness(p, l, ["k"], cell_us=cell).toPandas().sort_values(["k", "t0", "t1"])
    assert (got[["k", "t0", "t1", "n_labels"]].to_numpy() == want[["k", "t0", "t1", "n_labels"]].to_numpy()).all()
    assert np.abs(got.uniqueness.to_numpy() - want.uniqueness.to_numpy()).max() < 1e-14


def test_label_uniqueness_makes_no_pairs(spark):
    """20,000 labels that hold nearly all of 40,000 bars: 400 million ones."""
    n = 20_000
    l = spark.range(n).selectExpr("1L as k", "id as t0", f"id + {n} as t1")
    out = weights.label_uniqueness(l.selectExpr("k", "t0 as ts"), l, ["k"], cell_us=1000).toPandas().sort_values("t0")
    held = np.minimum(np.arange(2 * n) + 1, np.minimum(n + 1, 2 * n - np.arange(2 * n)))
    held = np.minimum(held, n)
    sums = np.concatenate([[0], np.cumsum(1 / held)])
    at = np.arange(n)
    assert np.allclose(out.uniqueness, (sums[at + n + 1] - sums[at]) / (n + 1), rtol=1e-9)


def test_many_trends_are_fitted_together_as_each_alone():
    r = np.random.default_rng(5)
    series = [np.cumsum(r.standard_normal(n)) for n in (40, 3, 61, 40, 25)] + [np.full(10, 2.0)]

    def alone(z):
        scale = z.std() or 1.0

        def loss(logs):
            h, q1, q2 = np.exp(np.clip(logs, -30, 10))
            x, p, f, total = np.array([z[0] / scale, 0.0]), np.eye(2) * 1e4, np.array([[1.0, 1.0], [0.0, 1.0]]), 0.0
            for v in z / scale:
                x, p = f @ x, f @ p @ f.T + np.diag([q1, q2])
                s, e = p[0, 0] + h, v - x[0]
                total += 0.5 * (math.log(2 * math.pi * s) + e * e / s)
                x, p = x + p[:, 0] / s * e, p - np.outer(p[:, 0] / s, p[0])
            return total

        logs, v = nelder_mead(loss, [-2.0, -2.0, -4.0], steps=200)
        return [*(np.exp(np.clip(logs, -30, 10)) * scale**2), -v - len(z) * math.log(scale)]

    out = models.local_trends(series)
    assert np.allclose(np.column_stack([out[k] for k in ("measurement", "level", "slope", "loglik")]), [alone(z) for z in series], rtol=1e-6)
    # One by one these took minutes.
    start = time.process_time()
    assert np.isfinite(models.local_trends([np.cumsum(r.standard_normal(60)) for _ in range(400)])["loglik"]).all()
    assert time.process_time() - start < 60


def test_figarch_sums_a_thousand_lags_for_every_length():
    r = 0.5 + np.random.default_rng(3).random(1300)
    omega, phi, d, beta = 0.1, 0.2, 0.4, 0.3
    delta, pi = [d], [phi - beta + d]
    for k in range(1, 1000):
        delta.append((k - d) / (k + 1) * delta[-1])
        pi.append(beta * pi[-1] + delta[k] - phi * delta[k - 1])
    for n in (5, 100, 1300):
        w = 0.94 ** np.arange(min(n, 75))
        x = np.concatenate([np.full(1000, (w * r[: len(w)] ** 2).sum() / w.sum()), r[:n] ** 2])
        want = [omega / (1 - beta) + sum(pi[i] * x[999 + t - i] for i in range(1000)) for t in range(n)]
        assert np.allclose(models.conditional_variance("figarch", r[:n], np.array([omega, phi, d, beta])), want)


def test_importances_score_every_feature(monkeypatch):
    from barloom.plans import models as plans

    seen = []
    for f in ("mean_decrease_accuracy", "single_feature_importance"):
        monkeypatch.setattr(plans.L, f, lambda e, rows, features, label: seen.append(features))
    for f in ("_frame", "_folded", "_logit"):
        monkeypatch.setattr(plans, f, lambda *a: None)
    plans.mean_decrease_accuracy(None, "")
    plans.single_feature_importance(None, "")
    assert seen == [plans.FEATURES] * 2


def test_bagging_covers_every_label_of_every_series(spark):
    from barloom.operators import ml

    r = np.random.default_rng(6)
    a = np.sort(r.integers(0, 3000, 500))
    boot = weights.Bootstrap(a, a + r.integers(0, 60, 500))
    assert boot.draw_local(seed=5, width=32) == boot.draw(seed=5)  # the same draws
    rows = [(k, i, i, i + 3, float(i % 40 < 20), float(i % 40)) for k, n in ((1, 200), (2, 1)) for i in range(n)]
    out = ml.series_bagging(points(spark, rows, "k long, seq long, t0 long, t1 long, label double, x double"), ["k"], ["seq"], ["x"], "label", estimators=6).toPandas()
    assert len(out) == 201 and out[out.k == 2].n.iloc[0] == 0 and out[out.k == 2].oob.isna().all()
    seen = out[out.n > 0]
    assert len(seen) > 150 and ((seen.oob > 0.5) == seen.label).mean() > 0.95


def test_bagging_query_has_a_row_per_label(spark, folder):
    import __spark_entry__ as entry
    from barloom.plans.models import _samples

    assert entry.queries()["sequential_bagging"](spark, folder).count() == _samples(spark, folder).count()


def test_sizes_are_fitted_to_any_number_of_rows(spark, monkeypatch):
    r = np.random.default_rng(8)
    p = r.random(60)
    df = points(spark, [(float(a), float((a - 0.4) * 0.1 + 0.02 * b)) for a, b in zip(p, r.standard_normal(60))], "prob double, ret double").coalesce(1)
    fits = (betsize.optimal_linear, betsize.optimal_sigmoid)
    want = [f(df, "prob", "ret") for f in fits]
    monkeypatch.setattr(betsize, "MAX_FIT", 10)
    losses = []
    for f in fits:
        monkeypatch.setattr(betsize, "nelder_mead", lambda loss, *a, **k: (losses.append([loss(np.array(v)) for v in ([1.0, 0.0], [3.0, -1.5])]), ([0.0, 0.0], 0.0))[1])
        f(df, "prob", "ret")
    size = (lambda v: np.clip(v[0] * p + v[1], 0, 1), lambda v: 1 / (1 + np.exp(-(v[0] * p + v[1]))))
    ret = np.array([x.ret for x in df.collect()])
    assert np.allclose(losses, [[-betsize._ratio(s(v) * ret) for v in ([1.0, 0.0], [3.0, -1.5])] for s in size])
    monkeypatch.setattr(betsize, "nelder_mead", nelder_mead)
    assert np.allclose(betsize.optimal_linear(df, "prob", "ret"), want[0], rtol=1e-4)
