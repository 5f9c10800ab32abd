"""Matrices as tables, Kalman states, views, mapped functions, weighted and bagged fits: against known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from barloom.functions import entropy as E
from barloom.functions.selection import exact_quantiles
from barloom.numeric import matrices as N
from barloom.numeric import portfolio as P
from barloom.operators import bars as R
from barloom.operators import mapping
from barloom.operators import matrices as M
from barloom.operators import ml as L
from barloom.operators import signals as S
from barloom.sources import ticks as files


@pytest.fixture(scope="module")
def market(spark):
    """Two blocks of four assets, each with a factor of its own, over 400 dates."""
    rng = np.random.default_rng(1)
    factors = rng.standard_normal((400, 2))
    x = np.column_stack([factors[:, k // 4] + 0.6 * rng.standard_normal(400) for k in range(8)]) * 0.01
    rows = [(d, a, float(x[d, a])) for d in range(400) for a in range(8)]
    return spark.createDataFrame(rows + [(d, 99, 0.0) for d in range(400)] + [(0, 5, None)], "day long, asset int, ret double"), x


def square(df, n=8):
    m = np.zeros((n, n))
    for r in df.collect():
        m[r.a, r.b] = m[r.b, r.a] = r.value
    return m


def test_treated_correlations(spark, market):
    df, x = market
    raw = square(M.treated_correlation(df, "day", "asset", "raw"))
    np.testing.assert_allclose(raw, np.corrcoef(x, rowvar=False), atol=1e-9)  # the asset without a variance is left out
    edge = M.noise_edge(df, "day", "asset").first()
    assert edge.factors == 2 and edge.q == pytest.approx(50)
    np.testing.assert_allclose(square(M.treated_correlation(df, "day", "asset", "denoised", factors=2)), N.denoise(raw, 2), atol=1e-9)
    np.testing.assert_allclose(square(M.treated_correlation(df, "day", "asset", "shrunk", factors=2, alpha=0.5)), N.shrink_noise(raw, 2, 0.5), atol=1e-9)
    toned = square(M.treated_correlation(df, "day", "asset", "detoned"))
    np.testing.assert_allclose(toned, N.detone(raw), atol=1e-9)
    with pytest.raises(ValueError):
        M.treated_correlation(df, "day", "asset", "other")
    assert M.treated_correlation(df.where("1 = 0"), "day", "asset", "denoised").count() == 0


def test_projected_covariance_keeps_variances():
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 4.0, 1.8], [-0.9, 1.8, 9.0]]) * np.outer([1, 1, 1], [1, 1, 1])
    bad[0, 2] = bad[2, 0] = -2.9
    good = N.semidefinite(bad)
    assert np.linalg.eigvalsh(good)[0] > -1e-9 and np.linalg.eigvalsh(bad)[0] < 0
    np.testing.assert_allclose(np.diag(good), np.diag(bad))


def test_clusters_and_critical_line(spark, market):
    df, x = market
    labels = {r.asset: r.cluster for r in M.asset_clusters(df, "day", "asset").collect()}
    assert len({labels[a] for a in range(4)}) == 1 and len({labels[a] for a in range(4, 8)}) == 1 and labels[0] != labels[7]
    d = df.where("asset < 8")
    cov, mu = np.cov(x, rowvar=False) * 252, x.mean(axis=0) * 252
    for solution in ("cla_turning_points", "min_volatility", "max_sharpe", "efficient_frontier"):
        points = M.critical_line(d, "day", "asset", solution).toPandas()
        sums = points.groupby("point").weight.sum()
        assert np.allclose(sums, 1) and (points.weight > -1e-9).all()
        if solution == "min_volatility":
            w = points.sort_values("asset").weight.to_numpy()
            np.testing.assert_allclose(w, P.min_volatility(cov), atol=1e-3)
            assert points.volatility.iloc[0] == pytest.approx(math.sqrt(w @ cov @ w)) and points.mean_return.iloc[0] == pytest.approx(mu @ w)


def test_views_hold_and_match_the_dual_on_the_driver(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(300)
    df = spark.createDataFrame([(float(v), 1.0 if i % 2 else 2.0) for i, v in enumerate(x)], "x double, p double")
    out, _ = M.pooled_probabilities(df, {"mean": (F.col("x"), 0.4), "square": (F.col("x") * F.col("x"), 1.1)}, "p")
    pdf = out.toPandas()
    assert pdf.probability.sum() == pytest.approx(1) and (pdf.probability * pdf.x).sum() == pytest.approx(0.4) and (pdf.probability * pdf.x**2).sum() == pytest.approx(1.1)
    prior = pdf.p.to_numpy() / pdf.p.sum()
    want = P.entropy_pooling(prior, np.vstack([np.ones(300), pdf.x, pdf.x**2]), np.array([1, 0.4, 1.1]))
    np.testing.assert_allclose(pdf.probability, want, atol=1e-8)


def test_distances_dynamic_weights_blocks_and_antithetic_rows(spark, market):
    w = {r.asset: r.weight for r in M.distance_weights(market[0].where("asset < 8"), "day", "asset").collect()}
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    mus, cov, costs = [np.array([0.02, 0.01]), np.array([0.0, 0.03])], np.array([[0.04, 0.01], [0.01, 0.02]]), [np.array([0.001, 0.001])] * 2
    best, path = P.dynamic_optimum(mus, [cov, cov], costs, 4)
    got = M.dynamic_weights(spark, mus, [cov, cov], costs, 4).orderBy("horizon", "asset").collect()
    assert got[0].sharpe == pytest.approx(best) and [r.weight for r in got] == pytest.approx(path.ravel().tolist())
    m = square(M.block_market(spark, 12, 3, 2), 12)
    assert np.linalg.eigvalsh(m)[0] > 0 and np.allclose(np.diag(m), 1)
    a = M.antithetic_regression(spark, 2000).agg(F.avg("y").alias("y"), F.avg("x_0").alias("x"), F.corr("y", "x_1").alias("c"), F.count("y").alias("n")).first()
    assert abs(a.y) < 1e-12 and abs(a.x) < 1e-12 and a.n == 2000 and 0.5 < a.c < 0.65


def test_kalman_states_match_the_array_version(spark):
    rng = np.random.default_rng(5)
    z = np.cumsum(rng.standard_normal(80))
    df = spark.createDataFrame([(k, i, float(v)) for k in (1, 2) for i, v in enumerate(z)] + [(3, 0, None), (3, 1, 2.0)], "k int, t long, x double")
    out = S.kalman_states(df, ["k"], "t", "x").orderBy("k", "t").collect()
    xs, sm = S.kalman_smooth(z)
    for k in (1, 2):
        rows = [r for r in out if r.k == k]
        np.testing.assert_allclose([(r.level, r.slope) for r in rows], xs, atol=1e-8)
        np.testing.assert_allclose([(r.smooth_level, r.smooth_slope) for r in rows], sm, atol=1e-8)
    assert len([r for r in out if r.k == 3]) == 2 and S.kalman_states(df.where("1 = 0"), ["k"], "t", "x").count() == 0


def test_decile_messages(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(60)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(1, 99, None)], "k int, t long, r double")
    out = E.decile_entropy(df, ["k"], "t", "r", exact_quantiles(df, ["k"], "r", [i / 10 for i in range(1, 10)])).orderBy("t").collect()
    digits = "".join(str(int(d)) for d in np.searchsorted(np.quantile(x, [i / 10 for i in range(1, 10)]), x))
    assert len(out) == 60 and [r.entropy for r in out[:9]] == [None] * 9
    assert [r.entropy for r in out[9:]] == pytest.approx([E.kontoyiannis(digits[i - 9 : i + 1]) for i in range(9, 60)])


def test_mapped_index(spark):
    assert mapping.linear_bounds(10, 3) == [0, 4, 7, 10] and mapping.linear_bounds(2, 5) == [0, 1, 2] and mapping.linear_bounds(0, 3) == [0, 0]
    for upper in (False, True):
        b = mapping.nested_bounds(1000, 8, upper)
        work = [sum((1000 - i if upper else i + 1) for i in range(s, e)) for s, e in zip(b, b[1:])]
        assert b[0] == 0 and b[-1] == 1000 and max(work) < 1.2 * min(work)
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    out = mapping.map_index(df, ["id"], lambda p: pd.DataFrame({"first": [p.id.min()], "last": [p.id.max()], "n": [len(p)]}), "first long, last long, n long", 7, nested=True)
    rows = sorted(map(tuple, out.collect()))
    assert sum(r[2] for r in rows) == 100 and all(b - a + 1 == n for a, b, n in rows) and len(rows) == 7
    assert mapping.map_index(df.where("1 = 0"), ["id"], lambda p: p, "id long, x long", 3).count() == 0


def test_bar_functions(spark):
    t = spark.createDataFrame([(1, i, float(i % 5), 2.0) for i in range(20)], "instrument int, seq long, price double, volume double").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    out = R.bars_with_features(t, R.tick_bars(t, threshold=10), [R.bar_function("last_less_first", lambda c: c["price"][-1] - c["price"][0])]).collect()
    assert [r.last_less_first for r in out] == [4.0, 4.0]


def labelled(spark, n=400):
    rng = np.random.default_rng(7)
    x = rng.standard_normal(n)
    right = (x > 0).astype(float)
    rows = [(float(v), float(y if i % 2 else 1 - y), 1.0 if i % 2 else 1e-6, i % 3) for i, (v, y) in enumerate(zip(x, right))]
    df = spark.createDataFrame(rows, "x double, label double, weight double, split int")
    return df.withColumn("role", F.lit("test")).unionByName(df.withColumn("split", F.pmod(F.col("split") + 1, F.lit(3)).cast("int")).withColumn("role", F.lit("train")))


def test_weights_change_the_fit(spark):
    """Half of the labels are inverted and weigh next to nothing: only the weighted fit sees through it."""
    rows, lr = labelled(spark), LogisticRegression(featuresCol=L.FEATURES, labelCol="label", maxIter=20)
    heavy = rows.withColumn("weight", F.col("weight"))
    plain = L.weighted(lr, None).fit(L.assemble(heavy, ["x"])).coefficients[0]
    weighty = L.weighted(lr, "weight").fit(L.assemble(heavy, ["x"])).coefficients[0]
    assert weighty > 1 > abs(plain)
    assert np.mean(L.cross_val_scores(lr, rows, ["x"], "label", "weight", L.accuracy)) > 0.9
    with pytest.raises(ValueError):
        L.weighted(MultilayerPerceptronClassifier(), "weight")


def test_bagged_grid_search(spark):
    rows, lr = labelled(spark), LogisticRegression(featuresCol=L.FEATURES, labelCol="label", maxIter=10)
    best, score, model = L.grid_search(lr, {"regParam": [0.0, 0.1]}, rows, ["x"], "label", "weight", bagging=3, max_samples=0.7)
    assert score > 0.9 and len(model.models) == 3 and len({float(m.coefficients[0]) for m in model.models}) == 3
    out = model.transform(L.assemble(rows.where("role = 'test' and weight = 1"), ["x"]))
    assert L.accuracy(out, "label") > 0.9 and L.log_loss(out, "label") < 0.5


def test_csv_order_is_by_whole_path(spark, tmp_path):
    for folder, name, price in (("x", "a.csv", 1), ("y", "a.csv", 2), ("x", "ba.csv", 3)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"date_time,price,volume\n2020-01-01 00:00:00,{price},1\n")
    paths = [str(tmp_path / p) for p in ("y/a.csv", "x/ba.csv", "x/a.csv")]
    assert [r.price for r in files.read_tick_csv(spark, paths).orderBy("seq").collect()] == [2.0, 3.0, 1.0]


def test_sizing_with_calibration(spark):
    from barloom.operators import betsize as Z

    rng = np.random.default_rng(8)
    p = rng.random(500)
    hit = rng.random(500) < p**2
    df = spark.createDataFrame([(float(a), float(0.01 if h else -0.01), float(h)) for a, h in zip(p, hit)], "prob double, ret double, label double")
    out = {r.method: r.sharpe for r in Z.sizing_bakeoff(df, df, label="label").collect()}
    assert len(out) == 16 and {m.removesuffix("_isotonic") for m in out} == {m for m in out if not m.endswith("_isotonic")}
    assert out["buy_and_hold"] == pytest.approx(out["buy_and_hold_isotonic"]) and out["all_or_nothing_isotonic"] > out["all_or_nothing"]
