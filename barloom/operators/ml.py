"""Models over feature tables: scores under purged folds, feature importance, model fingerprints, orthogonal features, sequentially
bootstrapped bagging, causal effects, calibration.

Folds are a column pair of a fold table (``split``, ``role``) as ``validation.purged_folds`` makes it; estimators are those of
pyspark.ml and train distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from barloom.functions.selection import quantile_list
from barloom.numeric.trees import Tree
from barloom.operators.weights import Bootstrap
from barloom.ordering import with_position

FEATURES = "_features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip").transform(df)


def log_loss(predictions: DataFrame, label: str, weight: str | None = None) -> float:
    """Weighted mean of -ln p of the true class."""
    p = F.get(vector_to_array("probability"), F.col(label).cast("int"))
    w = F.col(weight) if weight else F.lit(1.0)
    return float(predictions.agg(F.sum(-F.ln(F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))) * w) / F.sum(w)).first()[0])


def accuracy(predictions: DataFrame, label: str, weight: str | None = None) -> float:
    w = F.col(weight) if weight else F.lit(1.0)
    return float(predictions.agg(F.sum(F.when(F.col("prediction") == F.col(label), w).otherwise(0.0)) / F.sum(w)).first()[0])


Scorer = Callable[[DataFrame, str, str | None], float]


def f1(predictions: DataFrame, label: str, weight: str | None = None) -> float:
    hit = lambda a, b: F.sum(F.when((F.col(label) == a) & (F.col("prediction") == b), F.col(weight) if weight else F.lit(1.0)).otherwise(0.0))
    tp, fp, fn = predictions.agg(hit(1, 1), hit(0, 1), hit(1, 0)).first()
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def neg_log_loss(predictions: DataFrame, label: str, weight: str | None = None) -> float:
    return -log_loss(predictions, label, weight)


def _splits(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("split").distinct().collect())


def weighted(estimator: Estimator, weight: str | None) -> Estimator:
    """The estimator with the sample weights of a column in its fit."""
    if weight is None:
        return estimator
    if not estimator.hasParam("weightCol"):
        raise ValueError(f"{type(estimator).__name__} takes no sample weights")
    return estimator.copy({estimator.getParam("weightCol"): weight})


class Bagged:
    """``n`` copies of a classifier, each fitted on its own bootstrap of the rows, which vote with the mean of their probabilities."""

    def __init__(self, estimator: Estimator, n: int, max_samples: float = 1.0, seed: int = 0) -> None:
        self.estimator, self.n, self.max_samples, self.seed = estimator, n, max_samples, seed

    def fit(self, rows: DataFrame) -> "BaggedModel":
        """A row is drawn a Poisson number of times, by a hash of the row and so on every executor alike."""
        return BaggedModel([self.estimator.fit(rows.sample(True, self.max_samples, self.seed + i)) for i in range(self.n)])


class BaggedModel:
    def __init__(self, models: Sequence[Model]) -> None:
        self.models = list(models)

    def transform(self, rows: DataFrame) -> DataFrame:
        out, names = rows, []
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("probability", f"_p{i}").drop("rawPrediction", "prediction")
            names.append(f"_p{i}")
        total = vector_to_array(names[0])
        for n in names[1:]:
            total = F.zip_with(total, vector_to_array(n), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform(total, lambda x: x / len(names))).drop(*names)
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("probability"))


def cross_val_scores(estimator: Estimator, rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, score: Scorer = neg_log_loss) -> list[float]:
    """One score per split of rows with ``split`` and ``role``. The estimator reads the features from ``FEATURES``; ``weight`` weighs the rows in the fit and in
    the score."""
    data = assemble(rows, features)
    out = []
    for k in _splits(rows):
        model = weighted(estimator, weight).fit(data.where((F.col("split") == k) & (F.col("role") == "train")))
        out.append(score(model.transform(data.where((F.col("split") == k) & (F.col("role") == "test"))), label, weight))
    return out


def grid_search(estimator: Estimator, grid: dict[str, Sequence], rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, score: Scorer | None = None, tries: int | None = None, seed: int = 0, bagging: int = 0, max_samples: float = 1.0) -> tuple[dict, float, Model | BaggedModel]:
    """The parameters of the best mean score over purged folds (f1 for labels 0 and 1, else negative log loss), all combinations or ``tries`` random ones, and the model
    fitted with them on all rows: with ``bagging`` so many of them on bootstraps of ``max_samples`` x the rows. ``weight`` weighs fits and scores."""
    if score is None:
        labels = {r[0] for r in rows.select(label).distinct().limit(3).collect()}
        score = f1 if labels <= {0, 1} else neg_log_loss
    choices = [dict(zip(grid, c)) for c in product(*grid.values())]
    if tries is not None and tries < len(choices):
        choices = [choices[i] for i in np.random.default_rng(seed).choice(len(choices), tries, replace=False)]
    best, at = -math.inf, choices[0]
    for c in choices:
        s = float(np.mean(cross_val_scores(estimator.copy({estimator.getParam(k): v for k, v in c.items()}), rows, features, label, weight, score)))
        if s > best:
            best, at = s, c
    everything = assemble(rows.where(F.col("role") == "test"), features)  # each row is tested once
    chosen = weighted(estimator.copy({estimator.getParam(k): v for k, v in at.items()}), weight)
    return at, best, (Bagged(chosen, bagging, max_samples, seed) if bagging else chosen).fit(everything)


def log_uniform(low: float, high: float, n: int, seed: int = 0) -> list[float]:
    return [float(x) for x in np.exp(np.random.default_rng(seed).uniform(math.log(low), math.log(high), n))]


# Feature importance.


def mean_decrease_impurity(forest: Model, features: Sequence[str]) -> pd.DataFrame:
    """Mean and standard error over the trees of each feature's share of impurity decrease, unused ones left out, scaled to sum 1."""
    x = pd.DataFrame([t.featureImportances.toArray() for t in forest.trees], columns=list(features)).replace(0, np.nan)
    out = pd.DataFrame({"mean": x.mean(), "std": x.std() / math.sqrt(len(x))})
    return out / out["mean"].sum()


def mean_decrease_accuracy(estimator: Estimator, rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, score: Scorer = neg_log_loss, seed: int = 0) -> pd.DataFrame:
    """Mean and standard error over the splits of the relative loss when a feature is shuffled in the test rows. A feature is shuffled by
    joining its values back in a random order, so rows stay distributed."""
    data = assemble(rows, features)
    base, lost = [], {f: [] for f in features}
    for k in _splits(rows):
        model = weighted(estimator, weight).fit(data.where((F.col("split") == k) & (F.col("role") == "train")))
        test = rows.where((F.col("split") == k) & (F.col("role") == "test"))
        base.append(score(model.transform(assemble(test, features)), label, weight))
        for f in features:
            lost[f].append(score(model.transform(assemble(shuffled(test, f, seed + k), features)), label, weight))
    out = {}
    for f in features:
        top = 0.0 if score is neg_log_loss else 1.0
        d = np.array([(b - s) / (top - s) if top != s else 0.0 for b, s in zip(base, lost[f])])
        out[f] = {"mean": float(d.mean()), "std": float(d.std(ddof=1) / math.sqrt(len(d))) if len(d) > 1 else 0.0}
    return pd.DataFrame(out).T


def shuffled(rows: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """rows with one column's values in another order. Both sides are numbered by a seeded hash, distributed over range-sorted cells."""
    wide = 1 << 48
    keyed = rows.withColumn("_k", F.lit(0)).withColumn("_u", F.monotonically_increasing_id())
    one = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(s), "_u"), 1)
    a = with_position(keyed.withColumn("_o", one(seed)), ["_k"], "_o", ["_u"], cell_us=wide)
    b = with_position(keyed.select("_k", "_u", F.col(column).alias("_v")).withColumn("_o", one(seed + 7919)), ["_k"], "_o", ["_u"], cell_us=wide)
    return a.drop(column).join(b.select("_pos", F.col("_v").alias(column)), "_pos").select(*rows.columns)


def single_feature_importance(estimator: Estimator, rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, score: Scorer = neg_log_loss) -> pd.DataFrame:
    out = {}
    for f in features:
        s = np.array(cross_val_scores(estimator, rows, [f], label, weight, score))
        out[f] = {"mean": float(s.mean()), "std": float(s.std() / math.sqrt(len(s)))}
    return pd.DataFrame(out).T


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with each feature less its mean, over its standard deviation; one aggregate of the table."""
    s = df.agg(*[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s_{i}") for i, f in enumerate(features)]).first()
    return df.withColumns({f: F.try_divide(F.col(f) - F.lit(float(s[f"m_{i}"] or 0.0)), F.lit(float(s[f"s_{i}"] or 0.0))) for i, f in enumerate(features)})


def orthogonal_features(df: DataFrame, features: Sequence[str], share: float = 0.95, keep: Sequence[str] = ()) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The features' principal components that reach the share of variance, as columns pc_1 ..; the eigenvalues and vectors. Only the
    products of the features, one number per pair, come to the driver."""
    z = standardised(df, features)
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = z.agg(*[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(features), len(features)))
    for i, j in pairs:
        m[i, j] = m[j, i] = sums[f"p{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    n = int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    values, vectors = values[:n], vectors[:, :n]
    out = z.select(*keep, *[sum((F.col(f) * F.lit(float(vectors[i, k])) for i, f in enumerate(features)), F.lit(0.0)).alias(f"pc_{k + 1}") for k in range(n)])
    return out, values, vectors


def rank(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    i, j = np.triu_indices(len(x), 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    bottom = math.sqrt((a != 0).sum() * (b != 0).sum())
    return float((a * b).sum() / bottom) if bottom else float("nan")


def weighted_kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau with additive hyperbolic weights of the ranks, the mean over ranking by x and by y."""

    def one(r: np.ndarray) -> float:
        place = np.empty(len(r))
        place[np.lexsort((np.arange(len(r)), -r))] = np.arange(len(r))
        i, j = np.triu_indices(len(x), 1)
        w = 1 / (1 + place[i]) + 1 / (1 + place[j])
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        bottom = math.sqrt((w * (a != 0)).sum() * (w * (b != 0)).sum())
        return float((w * a * b).sum() / bottom) if bottom else float("nan")

    return (one(x) + one(y)) / 2


def importance_against_components(importance: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> dict[str, float]:
    """Agreement of feature importance with the components' loadings: Pearson, Spearman, Kendall, and weighted Kendall of the inverse component rank."""
    loads = np.concatenate([np.abs(vectors[:, k] * values[k]) for k in range(len(values))])
    many = np.tile(importance, len(values))
    order = rank(-np.abs(vectors * values).sum(axis=1))
    return {"pearson": float(np.corrcoef(many, loads)[0, 1]), "spearman": float(np.corrcoef(rank(many), rank(loads))[0, 1]), "kendall": kendall(many, loads), "weighted_kendall": weighted_kendall(importance, 1 / order)}


# Model fingerprints.


def fingerprint(model: Model, rows: DataFrame, features: Sequence[str], values: int = 20, pairs: Sequence[tuple[str, str]] = (), classification: bool = True) -> dict[str, dict[str, float]]:
    """Linear, non-linear and pairwise effects of each feature on the model's mean prediction, raw and as shares (``linear``, ``linear_share``, ...). The grid of quantiles is joined to
    the rows, so one pass of the model gives all of a feature's partial dependence."""
    target = F.get(vector_to_array("probability"), F.lit(1)) if classification else F.col("prediction")
    levels = [float(q) for q in np.linspace(0, 1, values)]
    grid = {f: quantile_list(rows, f, levels) for f in features}
    base = rows.select(*features)

    def dependence(*fs: str) -> np.ndarray:
        points = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(f"v{k}") for k, v in enumerate(c)]) for i, c in enumerate(product(*[grid[f] for f in fs]))])
        spread = base.withColumn("_g", F.explode(points)).withColumns({f: F.col(f"_g.v{k}") for k, f in enumerate(fs)})
        out = model.transform(assemble(spread, features)).groupBy(F.col("_g.i").alias("i")).agg(F.avg(target).alias("y")).orderBy("i").collect()
        return np.array([r.y for r in out])

    y = {f: dependence(f) for f in features}
    linear, other, joint = {}, {}, {}
    for f in features:
        x = np.array(grid[f])
        fit = np.polyval(np.polyfit(x, y[f], 1), x) if np.ptp(x) > 0 else np.full(len(x), y[f].mean())
        linear[f], other[f] = float(np.abs(fit - y[f].mean()).mean()), float(np.abs(fit - y[f]).mean())
    for a, b in pairs:
        both = dependence(a, b).reshape(values, values)
        rest = both - both.mean() - (y[a] - y[a].mean())[:, None] - (y[b] - y[b].mean())[None, :]
        joint[f"{a},{b}"] = float(np.abs(rest).sum() / values**2)
    share = lambda d: {k: v / sum(d.values()) if sum(d.values()) else 0.0 for k, v in d.items()}
    out = {"linear": linear, "linear_share": share(linear), "nonlinear": other, "nonlinear_share": share(other)}
    return out | ({"pairwise": joint, "pairwise_share": share(joint)} if pairs else {})


# Sequentially bootstrapped bagging.


def sequential_bagging(rows: DataFrame, features: Sequence[str], label: str, t0: str = "t0", t1: str = "t1", estimators: int = 10, max_samples: float = 1.0, max_features: float = 1.0, depth: int = 5, classification: bool = True, seed: int = 0, weight: str | None = None, max_rows: int = 200_000) -> tuple[DataFrame, float]:
    """Trees fitted on sequential bootstraps of label intervals, one estimator per task, and the out-of-bag score (accuracy or R squared).

    The result has one row per training row: ``row``, ``label``, ``oob`` (mean out-of-bag prediction, null without one) and ``n`` (trees it was out of). A bootstrap needs all labels in its task: more than
    ``max_rows`` are refused.
    """
    if rows.count() > max_rows:
        raise ValueError(f"more than {max_rows} labels")
    columns = [t0, t1, label, *features, *([weight] if weight else [])]
    data = rows.select(*columns).toPandas().sort_values([t0, t1]).reset_index(drop=True)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(data)
    feats = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        x, y = d[feats].to_numpy(float), d[label].to_numpy(float)
        w = d[weight].to_numpy(float) if weight else None
        boot = Bootstrap(d[t0].to_numpy(), d[t1].to_numpy())
        for batch in batches:
            for e in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed, e])
                cols = np.sort(rng.choice(len(feats), max(1, int(max_features * len(feats))), replace=False))
                drawn = np.array(boot.draw(max(1, int(max_samples * len(d))), seed * 1000 + e))
                tree = Tree(depth, classification).fit(x[drawn][:, cols], y[drawn], None if w is None else w[drawn])
                out = np.setdiff1d(np.arange(len(d)), drawn)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(tree.predict(x[out][:, cols]))], names=["row", "p"])

    votes = spark.range(0, estimators, 1, max(1, min(estimators, 64))).mapInArrow(run, "row bigint, p double")
    truth = spark.createDataFrame(pd.DataFrame({"row": np.arange(len(data)), "label": data[label].astype(float)}))
    out = truth.join(votes.groupBy("row").agg(F.avg("p").alias("oob"), F.count("p").alias("n")), "row", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen = out.where(F.col("oob").isNotNull())
    if classification:
        score = seen.agg(F.avg(F.when((F.col("oob") > 0.5).cast("double") == F.col("label"), 1.0).otherwise(0.0))).first()[0]
    else:
        score = seen.agg(1 - F.try_divide(F.sum(F.pow(F.col("label") - F.col("oob"), 2)), F.var_pop("label") * F.count("label"))).first()[0]
    return out, float(score) if score is not None else float("nan")


def series_bagging(rows: DataFrame, keys: Sequence[str], row: Sequence[str], features: Sequence[str], label: str, t0: str = "t0", t1: str = "t1", estimators: int = 10, depth: int = 5, classification: bool = True, seed: int = 0) -> DataFrame:
    """``sequential_bagging`` of each series by itself, for any number of rows: keys, ``row`` columns, ``label``, ``oob`` (mean out-of-bag
    prediction, null without one) and ``n`` (trees it was out of), one row per training row. Only labels of one series meet.

    A task has one bootstrap of one series, as a draw depends on all before it."""
    names = [*keys, *row, t0, t1, label, *features]
    data = rows.select(*names).withColumn(label, F.col(label).cast("double"))
    spread = data.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*keys, *row, label).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = int(pdf["_e"].iloc[0])
        pdf = pdf.sort_values([t0, t1, *row]).reset_index(drop=True)
        x, y = pdf[list(features)].to_numpy(float), pdf[label].to_numpy(float)
        drawn = np.array(Bootstrap(pdf[t0].to_numpy(), pdf[t1].to_numpy()).draw_local(None, seed * 1000 + e))
        p = Tree(depth, classification).fit(x[drawn], y[drawn]).predict(x)
        p[drawn] = np.nan
        return pdf[[*keys, *row, label]].assign(p=p)

    votes = spread.groupBy(*keys, "_e").applyInPandas(run, f"{kept}, p double")
    p = F.when(~F.isnan("p"), F.col("p"))
    return votes.groupBy(*keys, *row).agg(F.first(label).alias("label"), F.avg(p).alias("oob"), F.count(p).alias("n"))


# Causal effects and calibration.


def residuals(df: DataFrame, y: str, controls: Sequence[str], fold: str, out: str) -> DataFrame:
    """df with ``out``: y less its linear prediction from the controls, fitted on the other folds by normal equations (one aggregate per fold)."""
    x: list[Column] = [F.lit(1.0), *[F.col(c) for c in controls]]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = df.groupBy(fold).agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(c * F.col(y)).alias(f"b{i}") for i, c in enumerate(x)]).collect()
    out_col = F.lit(None).cast("double")
    for r in sums:
        a, b = np.zeros((len(x), len(x))), np.zeros(len(x))
        for s in sums:
            if s[fold] != r[fold]:
                for i, j in pairs:
                    a[i, j] += s[f"a{i}_{j}"] or 0.0
                b += [s[f"b{i}"] or 0.0 for i in range(len(x))]
        a = a + np.triu(a, 1).T
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        fit = sum((F.lit(float(k)) * c for k, c in zip(beta, x)), F.lit(0.0))
        out_col = F.when(F.col(fold) == r[fold], F.col(y) - fit).otherwise(out_col)
    return df.withColumn(out, out_col)


def double_ml(df: DataFrame, outcome: str, treatment: str, controls: Sequence[str], fold: str) -> dict[str, float]:
    """Partially linear effect of the treatment: residual on residual over cross-fitted folds, with its standard error."""
    rows = residuals(residuals(df, outcome, controls, fold, "_ry"), treatment, controls, fold, "_rt")
    s = rows.agg(F.sum(F.col("_rt") * F.col("_ry")).alias("ty"), F.sum(F.col("_rt") * F.col("_rt")).alias("tt"), F.count("_ry").alias("n")).first()
    effect = s.ty / s.tt
    meat = rows.agg(F.sum(F.pow(F.col("_rt") * (F.col("_ry") - effect * F.col("_rt")), 2))).first()[0]
    return {"effect": float(effect), "error": math.sqrt(meat) / s.tt, "n": int(s.n)}


def isotonic_calibration(train: DataFrame, rows: DataFrame, prob: str, label: str) -> DataFrame:
    """rows with ``calibrated``: the isotonic regression of the label on the probability."""
    model = IsotonicRegression(featuresCol=prob, labelCol=label, predictionCol="calibrated").fit(train.select(F.col(prob), F.col(label).cast("double").alias(label)))
    return model.transform(rows)


def test_features(n: int = 1000, features: int = 10, informative: int = 3, redundant: int = 3, seed: int = 0, sigma: float = 0.0) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A known-answer classification set: informative (I_), redundant (R_, an informative one plus noise) and noise (N_) features."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, features - redundant))
    y = (x[:, :informative].sum(axis=1) + 0.5 * rng.standard_normal(n) > 0).astype(float)
    names = [f"I_{i}" for i in range(informative)] + [f"N_{i}" for i in range(features - redundant - informative)]
    for k in range(redundant):
        source = int(rng.integers(informative))
        x = np.column_stack([x, x[:, source] + sigma * rng.standard_normal(n)])
        names.append(f"R_{k}")
    return x, y, names
