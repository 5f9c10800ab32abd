"""Queries of portfolios, simulation, pricing, likelihood models and machine learning. They have no SQL: tests hold them against known answers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.fold import fold, fold_together
from barloom.numeric import models as N
from barloom.operators import betsize as Z
from barloom.operators import ml as L
from barloom.operators import portfolio as P
from barloom.operators import pricing as O
from barloom.operators import simulate as S
from barloom.operators import validation as C
from barloom.operators.bars import tick_signs
from barloom.ordering import HOUR_US, even_cell
from barloom.plans.features import _days, lag_sql
from barloom.plans.inputs import DAILY_SQL, daily, ticks
from barloom.plans.labels import _bets
from barloom.plans.registry import query, table
from barloom.plans.statistics import _RET, _panel, _returns
from barloom.shared import materialize

KEYS = ["instrument"]


def _panel_returns(spark: SparkSession, folder: str) -> DataFrame:
    p = _panel(spark, folder).withColumn("price", F.exp("x"))
    return P.panel_returns(p, "day", "asset", "price", log=True)


def _allocation(solution: str) -> None:
    @query(f"portfolio_{solution}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return P.allocate(_panel_returns(spark, folder), "day", "asset", solution)

    run.__name__ = f"portfolio_{solution}"


for _s in P.SOLUTIONS:
    if _s not in ("max_sharpe", "inverse_variance"):
        _allocation(_s)


@query("portfolio_inverse_variance", """WITH p AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day, c_nationkey AS asset, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT asset, ln(x / lag(x) OVER (PARTITION BY asset ORDER BY day)) AS ret FROM p), v AS (SELECT asset, 1 / var_samp(ret) AS w FROM r WHERE ret IS NOT NULL GROUP BY 1)
SELECT asset, round(w / sum(w) OVER (), 6) AS weight FROM v""")
def portfolio_inverse_variance(spark: SparkSession, folder: str) -> DataFrame:
    return P.allocate(_panel_returns(spark, folder), "day", "asset", "inverse_variance").withColumn("weight", F.round("weight", 6))


@query("portfolio_max_sharpe")
def portfolio_max_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    r = _panel_returns(spark, folder)
    low = r.groupBy("asset").agg(F.avg("ret").alias("m")).agg(F.min("m")).first()[0]
    return P.allocate(r, "day", "asset", "max_sharpe", risk_free=float(low or 0.0) * 252, denoised=True)


@query("exponential_mean_return", f"""WITH {_RET}, k AS (SELECT instrument, ret, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) - 1 AS back FROM x)
SELECT instrument, round(sum(pow({1 - 2 / 501!r}, back) * ret) / sum(pow({1 - 2 / 501!r}, back)) * 252, 5) AS mean_return FROM k GROUP BY 1""")
def exponential_mean_return(spark: SparkSession, folder: str) -> DataFrame:
    return P.exponential_mean(_returns(spark, folder), "day", "instrument").withColumn("mean_return", F.round("mean_return", 5))


class _Gather:
    """Hands a whole series to a function at its end."""

    def __init__(self, fn) -> None:
        self.fn, self.parts = fn, []

    def feed(self, columns):
        x = columns["_x"].astype(float)
        self.parts.append(x[~np.isnan(x)])
        return {}

    def finish(self):
        return self.fn(np.concatenate(self.parts)) if self.parts else {}


def _per_series(df: DataFrame, order: str, value: str, fn, outputs: str) -> DataFrame:
    """A series without values is handed over too, as an empty array."""
    rows = df.select(*KEYS, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x"))
    return fold(rows, KEYS, ["_o"], ["_x"], lambda: _Gather(fn), outputs)


def _all_returns(spark: SparkSession, folder: str) -> DataFrame:
    """The days' returns with the null ones, so that every instrument has a row."""
    s = _days(spark, folder)
    return s.let(ret=s.change("c")).rows("instrument", "day", "ret")


def _volatility(model: str) -> None:
    @query(f"volatility_{model}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        def fit(x: np.ndarray) -> dict[str, np.ndarray]:
            names = ("mu", "omega", "loglik", "last_variance")
            if len(x) < N.VOLATILITY_PARAMETERS[model]:
                return {k: np.array([np.nan]) for k in names}
            out = N.fit_volatility(x, model)
            return {k: np.array([out[k]]) for k in names}

        return _per_series(_all_returns(spark, folder), "day", "ret", fit, "mu double, omega double, loglik double, last_variance double")

    run.__name__ = f"volatility_{model}"


for _m in N.VOLATILITY_MODELS:
    _volatility(_m)


@query("hidden_regimes")
def hidden_regimes(spark: SparkSession, folder: str) -> DataFrame:
    def fit(x: np.ndarray) -> dict[str, np.ndarray]:
        if len(x) < N.REGIME_PARAMETERS:
            return {"regime": np.arange(2)} | {k: np.full(2, np.nan) for k in ("mean", "variance", "stay")}
        out = N.hidden_regimes(x)
        return {"regime": np.arange(2), "mean": out["mean"], "variance": out["variance"], "stay": np.diag(out["transition"])}

    return _per_series(_all_returns(spark, folder), "day", "ret", fit, "regime int, mean double, variance double, stay double")


@query("local_trend")
def local_trend(spark: SparkSession, folder: str) -> DataFrame:
    def fit(series: list[np.ndarray]) -> dict[str, np.ndarray]:
        out = {k: np.full(len(series), np.nan) for k in ("measurement", "level", "slope", "loglik")}
        long = [i for i, x in enumerate(series) if len(x) >= N.TREND_PARAMETERS]
        if long:
            for k, v in N.local_trends([np.log(series[i]) for i in long]).items():
                out[k][long] = v
        return out

    days = daily(spark, folder).withColumn("c", F.when(F.col("c") > 0, F.col("c")))
    return fold_together(days, KEYS, ["day"], "c", fit, "measurement, level, slope, loglik")


@query("informed_trading")
def informed_trading(spark: SparkSession, folder: str) -> DataFrame:
    t = tick_signs(ticks(spark, folder), KEYS)
    by_day = t.groupBy("instrument", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).alias("day")).agg(F.sum(F.when(F.col("sign") > 0, 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("s"))
    rows = by_day.groupBy("instrument").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))

    def fit(batches):
        for pdf in batches:
            yield pd.DataFrame({"instrument": pdf.instrument, "pin": [N.informed_trading(np.array([b]), np.array([s])) for b, s in zip(pdf.b, pdf.s)]})

    return rows.mapInPandas(fit, "instrument bigint, pin double")


@query("reserve_size")
def reserve_size(spark: SparkSession, folder: str) -> DataFrame:
    """Net active positions of train's bets, sized by a two-normal mixture fitted to their moments; the runs fan out over tasks."""
    bets = Z.concurrent_sides(_bets(spark, folder), KEYS).withColumn("c", (F.col("active_long") - F.col("active_short")).cast("double"))
    m = bets.agg(F.avg("c").alias("m1"), *[F.avg(F.pow("c", F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4, 5)]).first()
    raw = [float(m[f"m{k}"]) for k in (1, 2, 3, 4, 5)]

    def run(batches):
        for pdf in batches:
            fits = [f for f in (N.fit_mixture(raw, int(i), epsilon=0.01, fifth=False) for i in pdf.id) if f]
            yield pd.DataFrame(fits, columns=["mu_1", "mu_2", "sigma_1", "sigma_2", "p_1", "error"])

    fits = spark.range(0, 16, 1, 8).mapInPandas(run, "mu_1 double, mu_2 double, sigma_1 double, sigma_2 double, p_1 double, error double").collect()
    if not fits:
        return bets.select("instrument", "seq", "c", F.lit(None).cast("double").alias("bet_size"))
    best = N.most_likely([f.asDict() for f in fits])
    p = [best[k] for k in ("mu_1", "mu_2", "sigma_1", "sigma_2", "p_1")]
    p[2], p[3] = max(p[2], 1e-6), max(p[3], 1e-6)
    return bets.select("instrument", "seq", "c", Z.mixture_size(F.col("c"), p).alias("bet_size"))


def _monte_carlo(spark: SparkSession) -> S.MonteCarlo:
    return S.MonteCarlo(spark, rate=0.03, start=100.0, maturity=1.0, sigma=0.2, paths=2000, steps=50, seed=7)


_PATHS = {
    "geometric": lambda m: m.geometric(), "vasicek": lambda m: m.vasicek(0.5, 0.04, 0.01), "square_root": lambda m: m.square_root(0.5, 0.04, 0.1),
    "heston": lambda m: m.heston(1.5, 0.04, 0.3, -0.6), "ornstein_uhlenbeck": lambda m: m.ornstein_uhlenbeck(2.0, 100.0, 5.0), "jump_diffusion": lambda m: m.jump_diffusion(1.0, -2.0, 3.0),
}


def _simulated(name: str, make) -> None:
    @query(f"paths_{name}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(_monte_carlo(spark)).groupBy("step").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))

    run.__name__ = f"paths_{name}"


for _n, _make in _PATHS.items():
    _simulated(_n, _make)


@query("paths_autoregressive")
def paths_autoregressive(spark: SparkSession, folder: str) -> DataFrame:
    return S.autoregressive(spark, [0.1, 0.2], 1000, 50).groupBy("step").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query("regime_series")
def regime_series(spark: SparkSession, folder: str) -> DataFrame:
    return S.Regimes((0.0, 0.0, 0.0), 10, (0.1, 0.05, 0.02), (-0.1, -0.05, -0.02), 0.01).series(spark, 4, 500, 0.3)


@query("synthetic_backtest")
def synthetic_backtest(spark: SparkSession, folder: str) -> DataFrame:
    grid = [i / 2 for i in range(21)]
    return S.synthetic_backtest(spark, 0.0, 5.0, 1.0, grid, grid, 2000)


@query("maximum_sharpe_distribution")
def maximum_sharpe_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return S.maximum_sharpe_distribution(spark, [10, 100], 1000).groupBy("trials").agg(F.avg("max_sr").alias("mean"), F.stddev_samp("max_sr").alias("std"))


@query("option_prices")
def option_prices(spark: SparkSession, folder: str) -> DataFrame:
    paths = _monte_carlo(spark).geometric()
    args = (100.0, 0.03, 1.0)
    rows = {
        "european_call": O.european(paths, *args, "call"), "european_put": O.european(paths, *args, "put"), "asian_call": O.asian(paths, *args, "call"), "asian_put_geometric": O.asian(paths, *args, "put", "geometric"),
        "lookback_call": O.lookback(paths, 0.03, 1.0, "call"), "barrier_up_out_call": O.barrier(paths, 100.0, 130.0, 0.03, 1.0), "barrier_up_in_call": O.barrier(paths, 100.0, 130.0, 0.03, 1.0, effect="in"),
        "parisian_down_out_put": O.barrier(paths, 100.0, 80.0, 0.03, 1.0, "put", "down", "out", 3), "american_put": O.american(paths, *args, "put"), "american_call": O.american(paths, *args, "call"), "futures": O.futures(paths).withColumn("error", F.lit(None).cast("double")),
    }
    out = None
    for name, df in rows.items():
        df = df.select(F.lit(name).alias("option"), "price", "error")
        out = df if out is None else out.unionByName(df)
    return out


# Machine learning on train: does the model's probability and the lagged return tell the target?

FEATURES = ["prob", "rets", "pmodel", "regime"]


def _samples(spark: SparkSession, folder: str, keep: Sequence[str] = ()) -> DataFrame:
    t = table(spark, folder, "train").where("prob between 0 and 1 and target is not null and rets between -1 and 1 and ts is not null")
    t0 = F.unix_micros("ts")
    # A label weighs as much as its return is large.
    weight = F.greatest(F.least(F.coalesce(F.abs(F.nanvl("target_rets", F.lit(0.0))), F.lit(0.0)), F.lit(1.0)), F.lit(1e-3)).alias("weight")
    return t.select(*keep, F.lit(0).alias("series"), t0.alias("t0"), (t0 + 4 * HOUR_US).alias("t1"), F.col("seq"), weight, F.col("target").cast("double").alias("label"), "prob", "rets", F.col("pmodel").cast("double").alias("pmodel"), F.col("regime").cast("double").alias("regime")).na.fill(0.0, ["pmodel", "regime"])


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    rows = _samples(spark, folder)
    # Folds of calendar time over all series together; labels are purged by their intervals.
    labels = rows.select("series", "t0", "t1").distinct()
    folds = C.purged_folds(labels, ["series"], 3, 0.01, cell_us=even_cell(labels, "t0"))
    # Read once per split and model: written once.
    return materialize(rows.join(folds.select("t0", "t1", "split", "role"), ["t0", "t1"]), "folds")


def _frame(spark: SparkSession, pdf: pd.DataFrame, name: str = "feature") -> DataFrame:
    out = pdf.rename_axis(name).reset_index()
    return spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else (float(x) if not isinstance(x, str) else x) for x in r) for r in out.itertuples(index=False)], ", ".join(f"{c} {'string' if c == name else 'double'}" for c in out.columns))


def _logit() -> LogisticRegression:
    return LogisticRegression(featuresCol=L.FEATURES, labelCol="label", maxIter=20)


@query("cross_val_scores")
def cross_val_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = L.cross_val_scores(_logit(), _folded(spark, folder), FEATURES, "label", "weight")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "split int, score double")


@query("grid_search")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    best, score, _ = L.grid_search(_logit(), {"regParam": [0.0, 0.1]}, _folded(spark, folder), FEATURES, "label", "weight", bagging=3)
    return spark.createDataFrame([(float(best["regParam"]), float(score))], "regParam double, score double")


@query("mean_decrease_impurity")
def mean_decrease_impurity(spark: SparkSession, folder: str) -> DataFrame:
    forest = RandomForestClassifier(featuresCol=L.FEATURES, labelCol="label", numTrees=20, maxDepth=4, seed=1).fit(L.assemble(_samples(spark, folder), FEATURES))
    return _frame(spark, L.mean_decrease_impurity(forest, FEATURES))


@query("mean_decrease_accuracy")
def mean_decrease_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _frame(spark, L.mean_decrease_accuracy(_logit(), _folded(spark, folder), FEATURES, "label"))


@query("single_feature_importance")
def single_feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _frame(spark, L.single_feature_importance(_logit(), _folded(spark, folder), FEATURES, "label"))


@query("orthogonal_features")
def orthogonal_features(spark: SparkSession, folder: str) -> DataFrame:
    return L.orthogonal_features(_samples(spark, folder), FEATURES, keep=["seq"])[0]


@query("model_fingerprint")
def model_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    rows = _samples(spark, folder)
    model = _logit().fit(L.assemble(rows, FEATURES))
    effects = L.fingerprint(model, rows, FEATURES, values=20, pairs=[("prob", "rets")])
    return spark.createDataFrame([(k, f, float(v)) for k, d in effects.items() for f, v in d.items()], "effect string, feature string, value double")


@query("sequential_bagging")
def sequential_bagging(spark: SparkSession, folder: str) -> DataFrame:
    return L.series_bagging(_samples(spark, folder, ["instrument"]), KEYS, ["seq"], FEATURES, "label", estimators=8)


@query("double_ml", """WITH t AS (SELECT CAST(target AS DOUBLE) AS y, prob AS d, rets AS x1, coalesce(CAST(pmodel AS DOUBLE), 0) AS x2, (seq % 4 + 4) % 4 AS f FROM train WHERE prob BETWEEN 0 AND 1 AND target IS NOT NULL AND rets BETWEEN -1 AND 1 AND ts IS NOT NULL),
m AS (SELECT a.f, avg(y) AS my, avg(d) AS md, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(y, x1) AS y1, covar_pop(y, x2) AS y2, covar_pop(d, x1) AS d1, covar_pop(d, x2) AS d2 FROM (SELECT DISTINCT f FROM t) a JOIN t b ON a.f <> b.f GROUP BY 1),
r AS (SELECT y - my - ((y1 * s22 - y2 * s12) * (x1 - m1) + (y2 * s11 - y1 * s12) * (x2 - m2)) / (s11 * s22 - s12 * s12) AS ry, d - md - ((d1 * s22 - d2 * s12) * (x1 - m1) + (d2 * s11 - d1 * s12) * (x2 - m2)) / (s11 * s22 - s12 * s12) AS rt FROM t JOIN m USING (f)),
e AS (SELECT sum(rt * ry) / sum(rt * rt) AS effect, sum(rt * rt) AS tt, count(*) AS n FROM r)
SELECT round(max(effect), 6) AS effect, round(sqrt(sum(pow(rt * (ry - effect * rt), 2))) / max(tt), 6) AS error, max(n) AS n FROM r, e""")
def double_ml(spark: SparkSession, folder: str) -> DataFrame:
    rows = _samples(spark, folder).withColumn("fold", F.expr("pmod(seq, 4)"))
    out = L.double_ml(rows, "label", "prob", ["rets", "pmodel"], "fold")
    return spark.createDataFrame([(round(out["effect"], 6), round(out["error"], 6), out["n"])], "effect double, error double, n long")


@query("isotonic_calibration")
def isotonic_calibration(spark: SparkSession, folder: str) -> DataFrame:
    rows = _samples(spark, folder)
    return L.isotonic_calibration(rows, rows.select("seq", "prob"), "prob", "label")


@query("lagged_sequences", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, day, rn, ln(c / {lag_sql('c')}) AS r FROM daily),
x AS (SELECT instrument, day, {", ".join(f"round({lag_sql('r', k) if k else 'r'}, 6) AS x_{k}" for k in range(5))} FROM r) SELECT * FROM x WHERE {" AND ".join(f"x_{k} IS NOT NULL" for k in range(5))}""")
def lagged_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The last five returns of each day: samples for sequence models."""
    s = _days(spark, folder)
    s.let(r=s.log_return("c"))
    s.let(**{f"x_{k}": F.round(s.lag("r", k) if k else F.col("r"), 6) for k in range(5)})
    return s.rows("instrument", "day", *[f"x_{k}" for k in range(5)]).na.drop()


def _levinson_sql(lags: int) -> str:
    """Partial autocorrelations f<k><k> from the autocorrelations a<k> of table g, in tables p1 .. p<lags>."""
    out = ["p1 AS (SELECT *, a1 AS f11 FROM g)"]
    for k in range(2, lags + 1):
        total = lambda other: " + ".join(f"f{k - 1}{j} * a{other(j)}" for j in range(1, k))  # noqa: B023, E731
        out.append(f"q{k} AS (SELECT *, (a{k} - ({total(lambda j: k - j)})) / (1 - ({total(lambda j: j)})) AS f{k}{k} FROM p{k - 1})")
        out.append(f"p{k} AS (SELECT *, {', '.join(f'f{k - 1}{j} - f{k}{k} * f{k - 1}{k - j} AS f{k}{j}' for j in range(1, k))} FROM q{k})")
    return ", ".join(out)


@query("autocorrelation", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, rn, ln(c / {lag_sql('c')}) AS r FROM daily), l AS (SELECT instrument, r, {", ".join(f"{lag_sql('r', k)} AS l{k}" for k in range(1, 6))} FROM r),
g AS (SELECT instrument, {", ".join(f"corr(r, l{k}) AS a{k}" for k in range(1, 6))}, count(l5) AS n FROM l GROUP BY 1 HAVING count(l5) >= 10 AND NOT isnan(corr(r, l1))), {_levinson_sql(5)}
SELECT instrument, unnest([1, 2, 3, 4, 5]) AS lag, round(unnest([{", ".join(f"a{k}" for k in range(1, 6))}]), 5) AS acf, round(unnest([{", ".join(f"f{k}{k}" for k in range(1, 6))}]), 5) AS pacf FROM p5""")
def autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    """Autocorrelation and partial autocorrelation of returns at lags 1 .. 5."""
    s = _days(spark, folder)
    s.let(r=s.log_return("c"))
    s.let(**{f"l{k}": s.lag("r", k) for k in range(1, 6)})
    acf = s.rows("instrument", "r", *[f"l{k}" for k in range(1, 6)]).groupBy("instrument").agg(*[F.corr("r", f"l{k}").alias(f"a{k}") for k in range(1, 6)], F.count("l5").alias("n")).where("n >= 10 and a1 is not null and not isnan(a1)")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = [getattr(r, f"a{k}") for k in range(1, 6)]
                out += [(r.instrument, k + 1, a[k], p) for k, p in enumerate(N.partial_autocorrelation(a))]
            yield pd.DataFrame(out, columns=["instrument", "lag", "acf", "pacf"])

    return acf.mapInPandas(run, "instrument bigint, lag int, acf double, pacf double").withColumns({c: F.round(c, 5) for c in ("acf", "pacf")})
