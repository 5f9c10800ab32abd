"""Queries of backtest statistics, risk measures, scores, structural breaks, entropies and distances."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import entropy as E
from barloom.functions.special import norm_cdf_sql
from barloom.operators import backtest as B
from barloom.operators import breaks as K
from barloom.operators import distance as D
from barloom.operators.bars import tick_signs
from barloom.ordering import with_position
from barloom.plans.features import YEAR, _days, lag_sql
from barloom.plans.inputs import DAILY_SQL, SIGNS_SQL, TICKS_SQL, daily, ticks
from barloom.plans.registry import query, table

KEYS = ["instrument"]
_RET = f"{DAILY_SQL}, r AS (SELECT instrument, day, rn, c, o, c / {lag_sql('c')} - 1 AS ret FROM daily), x AS (SELECT * FROM r WHERE ret IS NOT NULL)"
#: A position of -2 .. 2 from the day's number.
_POS = f"{DAILY_SQL}, pos AS (SELECT instrument, day, rn, CAST((day * 7 + instrument) % 5 AS DOUBLE) - 2 AS x FROM daily)"


def _returns(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    return s.let(ret=s.change("c")).rows("instrument", "day", "ret").where("ret is not null")


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).select("instrument", "day", (F.expr("cast((day * 7 + instrument) % 5 as double)") - 2).alias("x"))


@query("flattenings_and_flips", f"WITH {_POS}, p AS (SELECT *, lag(x) OVER w AS b, max(day) OVER (PARTITION BY instrument) AS z FROM pos WINDOW w AS (PARTITION BY instrument ORDER BY rn)) SELECT instrument, day FROM p WHERE (x = 0 AND (b IS NULL OR b <> 0)) OR x * b < 0 OR day = z")
def flattenings_and_flips(spark: SparkSession, folder: str) -> DataFrame:
    return B.flattenings_and_flips(_positions(spark, folder), KEYS, "day", "x")


@query("average_holding_period", f"""WITH RECURSIVE {_POS}, walk AS (SELECT instrument, rn, day, day AS day0, x, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS tw, 0.0::DOUBLE AS w FROM pos WHERE rn = 1
  UNION ALL SELECT p.instrument, p.rn, p.day, k.day0, p.x,
    CASE WHEN (p.x - k.x) * k.x >= 0 THEN CASE WHEN p.x <> 0 THEN (k.entry * k.x + (p.day - k.day0) * (p.x - k.x)) / p.x ELSE k.entry END WHEN p.x * k.x < 0 THEN p.day - k.day0 ELSE k.entry END,
    k.tw + CASE WHEN (p.x - k.x) * k.x < 0 THEN (p.day - k.day0 - k.entry) * (CASE WHEN p.x * k.x < 0 THEN abs(k.x) ELSE abs(p.x - k.x) END) ELSE 0 END,
    k.w + CASE WHEN (p.x - k.x) * k.x < 0 THEN (CASE WHEN p.x * k.x < 0 THEN abs(k.x) ELSE abs(p.x - k.x) END) ELSE 0 END
  FROM walk k JOIN pos p ON p.instrument = k.instrument AND p.rn = k.rn + 1)
SELECT instrument, round(arg_max(tw, rn) / nullif(arg_max(w, rn), 0), 6) AS holding_days FROM walk GROUP BY 1""")
def average_holding_period(spark: SparkSession, folder: str) -> DataFrame:
    return B.average_holding_period(_positions(spark, folder), KEYS, "day", "x").withColumn("holding_days", F.round("holding_days", 6))


def _hhi(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 AND sum({x}) <> 0 THEN (sum({x} * {x}) / (sum({x}) * sum({x})) - 1 / count({x})) / (1 - 1 / count({x})) END"


@query("bets_concentration", f"""WITH {_RET}, s AS (SELECT instrument, {_hhi('CASE WHEN ret >= 0 THEN ret END')} AS p, {_hhi('CASE WHEN ret < 0 THEN ret END')} AS n FROM x GROUP BY 1),
m AS (SELECT instrument, day // 30 AS m, count(*)::DOUBLE AS k FROM x GROUP BY 1, 2), t AS (SELECT instrument, {_hhi('k')} AS t FROM m GROUP BY 1)
SELECT s.instrument, round(p, 6) AS positive, round(n, 6) AS negative, round(t, 6) AS time FROM s JOIN t USING (instrument)""")
def bets_concentration(spark: SparkSession, folder: str) -> DataFrame:
    out = B.bets_concentration(_returns(spark, folder), KEYS, F.expr("day div 30"))
    return out.select("instrument", *[F.round(c, 6).alias(c) for c in ("positive", "negative", "time")])


@query("drawdowns", f"""WITH {DAILY_SQL}, h AS (SELECT *, max(c) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING) AS hwm FROM daily), m AS (SELECT instrument, hwm, min(c) AS lo, min(day) AS day FROM h GROUP BY 1, 2)
SELECT instrument, day, hwm, round(1 - lo / hwm, 6) AS drawdown, round((lead(day) OVER (PARTITION BY instrument ORDER BY day) - day) / 365.25, 6) AS years_under_water FROM m WHERE hwm > lo""")
def drawdowns(spark: SparkSession, folder: str) -> DataFrame:
    out = B.drawdowns(daily(spark, folder), KEYS, "day", "c", F.col("day"), cell_us=YEAR)
    return out.select("instrument", "day", "hwm", F.round("drawdown", 6).alias("drawdown"), F.round("years_under_water", 6).alias("years_under_water"))


_MOMENTS = """m AS (SELECT instrument, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS stdev, stddev_pop(ret) AS sp FROM x GROUP BY 1),
q AS (SELECT x.instrument, m.n, m.mean, m.stdev, CASE WHEN sp > 0 THEN avg(pow((ret - mean) / sp, 3)) END AS skew, CASE WHEN sp > 0 THEN avg(pow((ret - mean) / sp, 4)) END AS kurt FROM x JOIN m USING (instrument) WHERE m.n >= 10 GROUP BY x.instrument, m.n, m.mean, m.stdev, sp),
z AS (SELECT *, mean / nullif(stdev, 0) AS sr FROM q), y AS (SELECT *, sqrt((1 + 0.5 * sr * sr - skew * sr + (kurt - 3) / 4 * sr * sr) / (n - 1)) AS sr_std, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS zz FROM z)"""


@query("sharpe_statistics", f"WITH {_RET}, {_MOMENTS} SELECT instrument, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(sr, 6) AS sr, round(sr_std, 6) AS sr_std, round({norm_cdf_sql('zz')}, 6) AS psr FROM y")
def sharpe_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = B.sharpe_statistics(_returns(spark, folder), KEYS).where("n >= 10")
    return out.select("instrument", "n", *[F.round(c, d).alias(c) for c, d in (("mean", 6), ("stdev", 6), ("skew", 5), ("kurt", 5), ("sr", 6), ("sr_std", 6), ("psr", 6))])


def _expected_maxima(most: int) -> str:
    """(trials, factor) of the expected maximum of standard normals, for SQL, which has no normal quantile."""
    q = NormalDist().inv_cdf
    return ", ".join(f"({n}, {(1 - 0.5772156649015329) * q(1 - 1 / n) + 0.5772156649015329 * q(1 - 1 / (n * math.e))!r}::DOUBLE)" for n in range(2, most + 1))


@query("deflated_sharpe", f"""WITH {_RET}, {_MOMENTS}, f AS (SELECT instrument % 10 AS family, count(*) AS trials, stddev_pop(sr) AS sd, arg_max(struct_pack(sr := sr, n := n, skew := skew, kurt := kurt), (sr, n)) AS b FROM y WHERE sr IS NOT NULL GROUP BY 1),
g AS (SELECT family, trials, b.sr AS best_sr, b.n AS n, b.skew AS skew, b.kurt AS kurt, sd * coalesce(factor, 0) AS benchmark FROM f LEFT JOIN (VALUES {_expected_maxima(300)}) AS e(k, factor) ON k = trials),
h AS (SELECT *, (best_sr - benchmark) * sqrt(n - 1) / sqrt(1 - skew * best_sr + (kurt - 1) / 4 * best_sr * best_sr) AS zz FROM g) SELECT family, trials, round(best_sr, 6) AS best_sr, round(benchmark, 5) AS benchmark, round({norm_cdf_sql('zz')}, 5) AS dsr FROM h""")
def deflated_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    stats = B.sharpe_statistics(_returns(spark, folder), KEYS).where("n >= 10").withColumn("family", F.expr("instrument % 10"))
    return B.deflated_by_group(stats, ["family"]).withColumns({c: F.round(c, d) for c, d in (("best_sr", 6), ("benchmark", 5), ("dsr", 5))})


@query("implied_precision", f"""WITH {_RET}, g AS (SELECT instrument, avg(CASE WHEN ret > 0 THEN ret END) AS up, avg(CASE WHEN ret <= 0 THEN ret END) AS down, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS precision FROM x GROUP BY 1),
a AS (SELECT *, (252 + 1) * pow(up - down, 2) AS a, (2 * 252 * down - (up - down)) * (up - down) AS b, 252 * down * down AS c FROM g)
SELECT instrument, round(precision, 6) AS precision, round((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 6) AS needed FROM a WHERE up IS NOT NULL AND down IS NOT NULL AND up > down""")
def implied_precision(spark: SparkSession, folder: str) -> DataFrame:
    out = B.failure_probability(_returns(spark, folder), KEYS, 252.0, 1.0)
    return out.select("instrument", F.round("precision", 6).alias("precision"), F.round("needed", 6).alias("needed")).where("needed is not null")


@query("failure_probability", f"""WITH {_RET}, g AS (SELECT instrument, avg(CASE WHEN ret > 0 THEN ret END) AS up, avg(CASE WHEN ret <= 0 THEN ret END) AS down, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p FROM x GROUP BY 1),
a AS (SELECT *, (252 + 1) * pow(up - down, 2) AS a, (2 * 252 * down - (up - down)) * (up - down) AS b, 252 * down * down AS c FROM g), z AS (SELECT instrument, ((-b + sqrt(b * b - 4 * a * c)) / (2 * a) - p) / (p * (1 - p)) AS z FROM a WHERE up IS NOT NULL AND down IS NOT NULL)
SELECT instrument, round({norm_cdf_sql('z')}, 6) AS risk FROM z""")
def failure_probability(spark: SparkSession, folder: str) -> DataFrame:
    return B.failure_probability(_returns(spark, folder), KEYS, 252.0, 1.0).where("needed is not null").select("instrument", F.round("risk", 6).alias("risk"))


@query("precision_grid", "WITH s AS (SELECT unnest([-0.05, -0.03, -0.01]) AS stop), f AS (SELECT unnest([12.0, 52.0, 252.0]) AS freq), a AS (SELECT *, (freq + 1) * pow(0.04 - stop, 2) AS a, (2 * freq * stop - (0.04 - stop)) * (0.04 - stop) AS b, freq * stop * stop AS c FROM s, f) SELECT CAST(stop AS DOUBLE) AS stop, CAST(freq AS DOUBLE) AS freq, round((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 6) AS precision FROM a")
def precision_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = spark.createDataFrame([(s, f) for s in (-0.05, -0.03, -0.01) for f in (12.0, 52.0, 252.0)], "stop double, freq double")
    return grid.select("stop", "freq", F.round(B.implied_precision(F.col("stop"), F.lit(0.04), F.col("freq"), F.lit(1.0)), 6).alias("precision"))


@query("ou_parameters", f"""WITH {DAILY_SQL}, m AS (SELECT *, ln(c) AS lp, avg(ln(c)) OVER (PARTITION BY instrument) AS mu FROM daily), x AS (SELECT *, {lag_sql('lp')} - mu AS e FROM m)
SELECT instrument, round(regr_intercept(lp, e), 6) AS forecast, round(regr_slope(lp, e), 6) AS phi FROM x WHERE e IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def ou_parameters(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder)
    enough = d.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).where("n >= 11").select("instrument")
    out = B.ou_parameters(d.join(enough, "instrument", "left_semi"), KEYS, "day", "c")
    return out.select("instrument", F.round("forecast", 6).alias("forecast"), F.round("phi", 6).alias("phi"))


@query("value_at_risk", f"""WITH {_RET}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ret) AS i, count(*) OVER (PARTITION BY instrument) AS n FROM x), v AS (SELECT instrument, min(ret) AS var FROM k WHERE i >= ceil(0.05 * (n - 1) - 1e-9) + 1 GROUP BY 1)
SELECT v.instrument, round(v.var, 6) AS var, round(avg(x.ret), 6) AS expected_shortfall FROM v LEFT JOIN x ON x.instrument = v.instrument AND x.ret < v.var GROUP BY 1, 2""")
def value_at_risk(spark: SparkSession, folder: str) -> DataFrame:
    out = B.value_at_risk(_returns(spark, folder), KEYS, "ret")
    return out.select("instrument", F.round("var", 6).alias("var"), F.round("expected_shortfall", 6).alias("expected_shortfall"))


@query("conditional_drawdown", f"""WITH {DAILY_SQL}, a AS (SELECT *, max(c) OVER w - c AS dd FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, max(dd) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING) AS mdd FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY mdd) AS i, count(*) OVER (PARTITION BY instrument) AS n FROM b), v AS (SELECT instrument, min(mdd) AS q FROM k WHERE i >= ceil(0.05 * (n - 1) - 1e-9) + 1 GROUP BY 1)
SELECT v.instrument, round(avg(CASE WHEN mdd > q THEN mdd END), 6) AS cdar FROM v JOIN b USING (instrument) GROUP BY 1""")
def conditional_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return B.conditional_drawdown(daily(spark, folder), KEYS, "day", "c", cell_us=YEAR).withColumn("cdar", F.round("cdar", 6))


@query("classification_scores", """WITH t AS (SELECT instrument, target AS a, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS p FROM train WHERE prob BETWEEN 0 AND 1 AND target IS NOT NULL),
c AS (SELECT instrument, sum(CASE WHEN a = 1 AND p = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN a = 0 AND p = 1 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN a = 1 AND p = 0 THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN a = 0 AND p = 0 THEN 1.0 ELSE 0 END) AS tn FROM t GROUP BY 1)
SELECT instrument, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, CAST(tp + fn AS BIGINT) AS support, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS auc, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity FROM c""")
def classification_scores(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "train").where("prob between 0 and 1 and target is not null").select("instrument", F.col("target").alias("y_true"), F.when(F.col("prob") > 0.5, 1).otherwise(0).alias("y_pred"))
    out = B.classification_scores(t, KEYS)
    return out.select("instrument", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "auc", "specificity")])


@query("scores", """SELECT instrument, round(coalesce(sum(CASE WHEN target = 1 THEN prob - 0.5 ELSE 0 END) / nullif(sum(prob - 0.5), 0), 0), 4) AS pwa, sum(CASE WHEN CAST(prob > 0.5 AS INTEGER) = target THEN 100.0 ELSE -100.0 END) AS profit, round(avg(abs(target - prob)), 6) AS mae
FROM train WHERE prob BETWEEN 0 AND 1 AND target IS NOT NULL GROUP BY 1""")
def scores(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "train").where("prob between 0 and 1 and target is not null")
    y, p = F.col("target"), F.col("prob")
    return t.groupBy("instrument").agg(F.round(B.probability_weighted_accuracy(F.when(y == 1, 1.0).otherwise(0.0), p), 4).alias("pwa"), B.profit_score(y, p).cast("double").alias("profit"), F.round(B.mean_absolute_error(y, p), 6).alias("mae"))


@query("equity_curve", f"WITH {_RET} SELECT instrument, day, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY instrument ORDER BY day ROWS UNBOUNDED PRECEDING)), 5) AS equity FROM x")
def equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    return B.equity_curve(_returns(spark, folder), KEYS, "day", "ret").select("instrument", "day", F.round("equity", 5).alias("equity"))


@query("historical_return", f"WITH {_RET} SELECT instrument, round(avg(ret) * 252, 5) AS mean_return FROM x GROUP BY 1")
def historical_return(spark: SparkSession, folder: str) -> DataFrame:
    return _returns(spark, folder).groupBy("instrument").agg(F.round(F.avg("ret") * 252, 5).alias("mean_return"))


# Structural breaks.


@query("chow_type", f"""WITH {DAILY_SQL}, s AS (SELECT *, ln(c) AS p, {lag_sql('ln(c)')} AS x FROM daily), a AS (SELECT *, p - x AS y, count(*) OVER (PARTITION BY instrument) AS n FROM s),
t AS (SELECT instrument, day, rn, n FROM a WHERE rn - 1 >= 20 AND rn - 1 < n - 20), z AS (SELECT t.instrument, t.day, t.n, sum(CASE WHEN a.rn > t.rn THEN a.x * a.y END) AS xy, sum(CASE WHEN a.rn > t.rn THEN a.x * a.x END) AS xx, sum(a.y * a.y) AS yy FROM t JOIN a ON a.instrument = t.instrument GROUP BY 1, 2, 3)
SELECT instrument, day, round(xy / xx / sqrt((yy - xy / xx * xy) / (n - 2) / xx), 5) AS statistic FROM z""")
def chow_type(spark: SparkSession, folder: str) -> DataFrame:
    return K.chow_statistics(daily(spark, folder).withColumn("p", F.ln("c")), KEYS, "day", "p", cell_us=YEAR).withColumn("statistic", F.round("statistic", 5))


@query("cusum_statistics", f"""WITH {DAILY_SQL}, s AS (SELECT instrument, day, rn - 1 AS i, ln(c) AS y, ln(c) - {lag_sql('ln(c)')} AS d FROM daily), v AS (SELECT *, sum(d * d) OVER (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING) / nullif(i - 1, 0) AS s2 FROM s),
p AS (SELECT t.instrument, t.day, t.i - n.i AS gap, (t.y - n.y) / (t.s2 * sqrt(t.i - n.i)) AS s FROM v t JOIN v n ON n.instrument = t.instrument AND n.i < t.i WHERE t.i >= 2 AND t.s2 > 0)
SELECT instrument, day, round(max(s), 4) AS statistic FROM p GROUP BY 1, 2""")
def cusum_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = K.cusum_statistics(daily(spark, folder).withColumn("p", F.ln("c")), KEYS, "day", "p")
    return out.select("instrument", "day", F.round("statistic", 4).alias("statistic"))


def _sadf(model: str) -> None:
    @query(f"sadf_{model}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return K.sadf(daily(spark, folder).withColumn("p", F.ln("c") if model in ("linear", "quadratic") else F.col("c")), KEYS, "day", "p", model=model, lags=1, min_length=20, constant=True)

    run.__name__ = f"sadf_{model}"


for _model in K.SADF_MODELS:
    _sadf(_model)


# Entropy and distance.


@query("shannon_entropy", f"WITH {SIGNS_SQL}, c AS (SELECT instrument, sgn, count(*) AS n FROM signs GROUP BY 1, 2) SELECT instrument, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS shannon FROM c GROUP BY 1")
def shannon_entropy(spark: SparkSession, folder: str) -> DataFrame:
    letters = tick_signs(ticks(spark, folder), KEYS).withColumn("letter", E.tick_letter(F.col("sign")))
    return E.shannon_by_group(letters, KEYS, "letter").withColumn("shannon", F.round("shannon", 6))


@query("tick_messages", f"WITH {SIGNS_SQL} SELECT instrument, (rn - 1) // 20 AS bar, string_agg(CASE sgn WHEN 1 THEN 'a' WHEN -1 THEN 'b' ELSE 'c' END, '' ORDER BY rn) AS message FROM signs GROUP BY 1, 2")
def tick_messages(spark: SparkSession, folder: str) -> DataFrame:
    t = with_position(tick_signs(ticks(spark, folder), KEYS), KEYS, "ts", ["seq"])
    return t.groupBy("instrument", F.floor(F.col("_pos") / 20).alias("bar")).agg(E.message(["_pos"], E.tick_letter(F.col("sign"))).alias("message"))


@query("message_entropies")
def message_entropies(spark: SparkSession, folder: str) -> DataFrame:
    m = tick_messages(spark, folder)
    return m.select("instrument", "bar", *[E.entropy(F.col("message"), k).alias(k) for k in E.MEASURES])


@query("plug_in_entropy", f"""WITH {SIGNS_SQL}, l AS (SELECT instrument, (rn - 1) // 20 AS bar, rn, count(*) OVER (PARTITION BY instrument, (rn - 1) // 20) AS n, row_number() OVER (PARTITION BY instrument, (rn - 1) // 20 ORDER BY rn) AS i, sgn FROM signs),
c AS (SELECT instrument, bar, n - 1 AS n, sgn, count(*) AS k FROM l WHERE i < n GROUP BY 1, 2, 3, 4) SELECT instrument, bar, round(-sum(k / n * log2(k / n)) + 0.0, 6) AS plug_in FROM c GROUP BY 1, 2""")
def plug_in_entropy(spark: SparkSession, folder: str) -> DataFrame:
    m = tick_messages(spark, folder).where(F.length("message") > 1)
    return m.select("instrument", "bar", F.round(E.entropy(F.col("message"), "plug_in"), 6).alias("plug_in"))


_LEVELS = ", ".join(repr(0.01 + i * 0.11) for i in range(10))


@query("quantile_letters", f"""WITH {TICKS_SQL}, k AS (SELECT quantile_cont(volume, [{_LEVELS}]) AS q FROM ticks), d AS (SELECT instrument, seq, [abs(volume - v) FOR v IN (SELECT q FROM k)] AS d FROM ticks)
SELECT instrument, seq, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS letter FROM d""")
def quantile_letters(spark: SparkSession, folder: str) -> DataFrame:
    t = ticks(spark, folder)
    keys = E.quantile_keys(t, "volume", 10)
    return t.select("instrument", "seq", F.ascii(E.nearest_letter(F.col("volume"), keys)).alias("letter"))


@query("sigma_letters", f"""WITH {TICKS_SQL}, b AS (SELECT min(price) AS lo, max(price) AS hi FROM ticks), k AS (SELECT unnest(range(CAST(ceil((hi - lo) / 5.0::DOUBLE) AS BIGINT))) AS i, lo, (lo + 5.0::DOUBLE) - lo AS step FROM b)
SELECT instrument, seq, CAST(arg_min(i, (abs(price - (lo + i * step)), i)) AS INTEGER) AS letter FROM ticks, k GROUP BY 1, 2""")
def sigma_letters(spark: SparkSession, folder: str) -> DataFrame:
    t = ticks(spark, folder)
    keys = E.sigma_keys(t, "price", 5.0)
    return t.select("instrument", "seq", F.ascii(E.nearest_letter(F.col("price"), keys)).alias("letter"))


_BINS = E.univariate_bins(20)


@query("rolling_entropy", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, day, rn, ln(c / {lag_sql('c')}) AS r FROM daily),
w AS (SELECT instrument, day, list(r) OVER k AS l, min(r) OVER k AS lo, max(r) OVER k AS hi, count(r) OVER k AS n FROM r WINDOW k AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
b AS (SELECT instrument, day, lo, hi, unnest(l) AS x FROM w WHERE n = 20), c AS (SELECT instrument, day, CASE WHEN hi > lo THEN least(floor((x - lo) * ({_BINS} / (hi - lo))), {_BINS - 1}) ELSE 0 END AS i, count(*) / 20.0::DOUBLE AS p FROM b GROUP BY ALL),
h AS (SELECT instrument, day, -sum(p * ln(p)) AS h FROM c GROUP BY 1, 2) SELECT r.instrument, r.day, round(h.h + 0.0, 6) AS entropy FROM r LEFT JOIN h ON h.instrument = r.instrument AND h.day = r.day""")
def rolling_entropy(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    s.let(r=s.log_return("c"))
    frame = s.w.rowsBetween(-19, 0)
    s.let(window=F.when(F.count("r").over(frame) == 20, F.collect_list("r").over(frame)))
    return s.rows("instrument", "day", F.round(E.histogram_entropy(F.col("window"), _BINS), 6).alias("entropy"))


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order value per day and nation: 25 assets."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).alias("day"), F.col("c_nationkey").alias("asset")).agg(F.ln(F.avg("o_totalprice")).alias("x"))


_PAIRS = """p AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day, c_nationkey AS asset, ln(avg(o_totalprice)) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), q AS (SELECT p.asset AS a, r.asset AS b, p.x, r.x AS y FROM p JOIN p r ON p.day = r.day AND p.asset < r.asset)"""


@query("correlation_distance", f"WITH {_PAIRS} SELECT a, b, round(sqrt(2 * count(*) * (1 - corr(x, y))), 4) AS distance FROM q GROUP BY 1, 2 HAVING count(*) >= 10")
def correlation_distance(spark: SparkSession, folder: str) -> DataFrame:
    return D.correlation_distance(D.correlations(_panel(spark, folder), "day", "asset", "x", 10)).withColumn("distance", F.round("distance", 4))


@query("information_distance", f"""WITH {_PAIRS}, s AS (SELECT a, b, count(*) AS n, corr(x, y) AS r, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q GROUP BY 1, 2 HAVING count(*) >= 10),
t AS (SELECT *, CAST(round_even(sqrt(1 + sqrt(1 + 24 * n / (1 - r * r))) / sqrt(2.0), 0) AS INTEGER) AS bins FROM s), c AS (SELECT q.a, q.b, n, bins, least(floor((x - x0) / (x1 - x0) * bins), bins - 1) AS i, least(floor((y - y0) / (y1 - y0) * bins), bins - 1) AS j FROM q JOIN t ON t.a = q.a AND t.b = q.b),
h AS (SELECT a, b, n, bins, ln(n) - sum(k * ln(k)) / n AS h FROM (SELECT a, b, n, bins, i, count(*) AS k FROM c GROUP BY ALL) GROUP BY a, b, n, bins), g AS (SELECT a, b, ln(n) - sum(k * ln(k)) / n AS h FROM (SELECT a, b, n, j, count(*) AS k FROM c GROUP BY ALL) GROUP BY a, b, n), f AS (SELECT a, b, ln(n) - sum(k * ln(k)) / n AS h FROM (SELECT a, b, n, i, j, count(*) AS k FROM c GROUP BY ALL) GROUP BY a, b, n)
SELECT h.a, h.b, h.bins, round(h.h + g.h - f.h, 5) AS mi, round(h.h + g.h - 2 * (h.h + g.h - f.h), 5) AS vi FROM h JOIN g ON g.a = h.a AND g.b = h.b JOIN f ON f.a = h.a AND f.b = h.b""")
def information_distance(spark: SparkSession, folder: str) -> DataFrame:
    out = D.information(_panel(spark, folder), "day", "asset", "x")
    return out.select("a", "b", "bins", F.round("mi", 5).alias("mi"), F.round("vi", 5).alias("vi"))


@query("jensen_shannon")
def jensen_shannon(spark: SparkSession, folder: str) -> DataFrame:
    return D.jensen_shannon(_panel(spark, folder), "day", "asset", "x")


@query("spanning_tree")
def spanning_tree(spark: SparkSession, folder: str) -> DataFrame:
    corr = D.correlations(_panel(spark, folder), "day", "asset", "x", 10)
    tree = D.tree_of(corr.select("a", "b", F.sqrt(2 * (1 - F.col("corr"))).alias("distance")))
    return spark.createDataFrame([(int(u), int(v), float(w)) for w, u, v in tree], "a int, b int, distance double")
