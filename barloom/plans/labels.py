"""Queries of labelling, sample weights, cross-validation and bet sizing over the label intervals and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.special import norm_cdf_sql
from barloom.operators import betsize as Z
from barloom.operators import labeling as L
from barloom.operators import validation as C
from barloom.operators import weights as W
from barloom.plans.features import _days, lag_sql
from barloom.plans.inputs import DAILY_SQL, LABELS_SQL, PRICES_SQL, daily, labels, prices
from barloom.plans.registry import query, table
from barloom.shared import materialize

KEYS = ["instrument"]
HOUR = 3_600_000_000
_PL = f"WITH {PRICES_SQL}, {LABELS_SQL}"


@query("vertical_barriers", f"{_PL} SELECT l.instrument, l.t0, min(p.ts) AS vertical FROM labels l JOIN prices p ON p.instrument = l.instrument AND p.ts >= l.t0 + {8 * HOUR} GROUP BY 1, 2")
def vertical_barriers(spark: SparkSession, folder: str) -> DataFrame:
    return L.vertical_barriers(labels(spark, folder), prices(spark, folder), KEYS, 8 * HOUR).select("instrument", "t0", "vertical")


_TOUCH = """
last AS (SELECT instrument, max(ts) AS z FROM prices GROUP BY 1),
base AS (SELECT l.*, z, arg_min(p.close, p.ts) AS p0 FROM (SELECT l.*, z FROM labels l LEFT JOIN last USING (instrument)) l LEFT JOIN prices p ON p.instrument = l.instrument AND p.ts >= l.t0 GROUP BY ALL),
path AS (SELECT b.instrument, b.t0, p.ts, (p.close / b.p0 - 1) * b.side AS r, b.trgt, b.pt, b.sl FROM base b JOIN prices p ON p.instrument = b.instrument AND p.ts BETWEEN b.t0 AND coalesce(b.t1, z)),
hits AS (SELECT instrument, t0, min(CASE WHEN pt > 0 AND r > pt * trgt THEN ts END) AS pt_time, min(CASE WHEN sl > 0 AND r < -sl * trgt THEN ts END) AS sl_time FROM path GROUP BY 1, 2),
barriers AS (SELECT l.*, nullif(least(coalesce(l.t1, 9e18::BIGINT), coalesce(h.pt_time, 9e18::BIGINT), coalesce(h.sl_time, 9e18::BIGINT)), 9e18::BIGINT) AS touch FROM labels l LEFT JOIN hits h ON h.instrument = l.instrument AND h.t0 = l.t0 WHERE l.trgt > 0)"""


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    """The prices, written once: several joins of a query start from them."""
    return materialize(prices(spark, folder), "prices")


@query("triple_barrier", f"{_PL}, {_TOUCH} SELECT instrument, t0, touch, trgt, side FROM barriers")
def triple_barrier(spark: SparkSession, folder: str) -> DataFrame:
    return L.triple_barrier(_prices(spark, folder), labels(spark, folder), KEYS).select("instrument", "t0", "touch", "trgt", "side")


@query("meta_labels", f"""{_PL}, {_TOUCH},
e AS (SELECT b.*, (SELECT arg_min(close, ts) FROM prices p WHERE p.instrument = b.instrument AND p.ts >= b.t0) AS a, (SELECT arg_min(close, ts) FROM prices p WHERE p.instrument = b.instrument AND p.ts >= b.touch) AS z FROM barriers b WHERE touch IS NOT NULL),
r AS (SELECT *, ln(z / a) * side AS lr FROM e)
SELECT instrument, t0, round(exp(lr) - 1, 6) AS ret, trgt, CASE WHEN lr > 0 AND lr > trgt * pt THEN 1 ELSE 0 END AS bin, side FROM r WHERE a IS NOT NULL AND z IS NOT NULL""")
def meta_labels(spark: SparkSession, folder: str) -> DataFrame:
    p = _prices(spark, folder)
    out = L.meta_labels(p, L.triple_barrier(p, labels(spark, folder), KEYS), KEYS)
    return out.withColumn("ret", F.round("ret", 6))


@query("drop_rare_labels", f"""{_PL}, {_TOUCH},
e AS (SELECT b.*, (SELECT arg_min(close, ts) FROM prices p WHERE p.instrument = b.instrument AND p.ts >= b.t0) AS a, (SELECT arg_min(close, ts) FROM prices p WHERE p.instrument = b.instrument AND p.ts >= b.touch) AS z FROM barriers b WHERE touch IS NOT NULL),
m AS (SELECT instrument, t0, z / a - 1 AS ret, trgt, CASE WHEN z > a AND ln(z / a) > trgt * pt THEN 1 WHEN z < a AND ln(z / a) < -trgt * sl THEN -1 ELSE 0 END AS bin FROM e WHERE a IS NOT NULL AND z IS NOT NULL),
c AS (SELECT bin, count(*) AS n, row_number() OVER (ORDER BY count(*), CAST(bin AS VARCHAR)) AS k, count(*) OVER () AS kinds, sum(count(*)) OVER () AS total FROM m GROUP BY 1)
SELECT instrument, t0, round(ret, 6) AS ret, trgt, bin FROM m WHERE bin NOT IN (SELECT bin FROM c WHERE k = 1 AND kinds >= 3 AND n / total <= 0.05)""")
def drop_rare_labels(spark: SparkSession, folder: str) -> DataFrame:
    p = _prices(spark, folder)
    out = L.drop_rare_labels(L.meta_labels(p, L.triple_barrier(p, labels(spark, folder), KEYS), KEYS, with_side=False))
    return out.withColumn("ret", F.round("ret", 6))


@query("trend_labels", f"""WITH {DAILY_SQL}, f AS (SELECT d.instrument, d.day, h.h, count(*) AS n, max(e.day) AS z, regr_slope(e.c - d.c, e.rn - d.rn) AS b, regr_sxx(e.c - d.c, e.rn - d.rn) AS sxx, regr_syy(e.c - d.c, e.rn - d.rn) AS syy, regr_sxy(e.c - d.c, e.rn - d.rn) AS sxy
  FROM daily d, (SELECT unnest([3, 5, 8]) AS h) h, daily e WHERE e.instrument = d.instrument AND e.rn BETWEEN d.rn AND d.rn + h.h - 1 GROUP BY ALL),
t AS (SELECT *, greatest(syy - sxy * sxy / sxx, 0) AS sse FROM f WHERE n = h), v AS (SELECT *, CASE WHEN sse > 1e-10 * syy THEN b / sqrt(sse / (n - 2) / sxx) ELSE 0 END AS t FROM t)
SELECT instrument, day, round(arg_max(t, abs(t)), 4) AS t_value, sign(arg_max(t, abs(t)))::INTEGER AS bin, max(z) AS t1 FROM v GROUP BY 1, 2 HAVING count(*) = 3""")
def trend_labels(spark: SparkSession, folder: str) -> DataFrame:
    s = L.trend_scan(_days(spark, folder), "c", "day", [3, 5, 8])
    return s.rows("instrument", "day", F.round("t_value", 4).alias("t_value"), "bin", "t1").where("t_value is not null")


_TAILS = f"""WITH {DAILY_SQL}, r AS (SELECT instrument, day, rn, ln(c / {lag_sql('c')}) AS r FROM daily),
v AS (SELECT instrument, day, r / nullif(CASE WHEN count(r) OVER w = 10 THEN stddev_samp(r) OVER w END, 0) AS x FROM r WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
e AS (SELECT day, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM v WHERE x IS NOT NULL GROUP BY 1)
SELECT v.day, v.instrument, CASE WHEN x <= lo THEN -1 WHEN x > hi THEN 1 ELSE 0 END AS tail FROM v JOIN e USING (day) WHERE x IS NOT NULL"""


@query("tail_sets", _TAILS)
def tail_sets(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    s.let(_r=s.log_return("c")).let(_sd=s.roll(F.stddev_samp, "_r", 10))
    return L.tail_sets(s.rows("instrument", "day", F.try_divide("_r", "_sd").alias("x")), "day", "instrument", "x")


@query("tail_members", f"""WITH tails AS ({_TAILS})
SELECT day, coalesce(string_agg(CASE WHEN tail = 1 THEN instrument END, ' ' ORDER BY instrument), '') AS positive, coalesce(string_agg(CASE WHEN tail = -1 THEN instrument END, ' ' ORDER BY instrument), '') AS negative FROM tails GROUP BY 1""")
def tail_members(spark: SparkSession, folder: str) -> DataFrame:
    out = L.tail_members(tail_sets(spark, folder), "day", "instrument")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("positive", "negative")})


_CLOSED = "closed AS (SELECT l.instrument, l.t0, coalesce(l.t1, z) AS t1 FROM labels l LEFT JOIN (SELECT instrument, max(ts) AS z FROM prices GROUP BY 1) USING (instrument))"
_CONC = "conc AS (SELECT p.instrument, p.ts, p.close, count(c.t0) AS n FROM prices p LEFT JOIN closed c ON c.instrument = p.instrument AND p.ts BETWEEN c.t0 AND c.t1 GROUP BY 1, 2, 3)"


def _closed(spark: SparkSession, folder: str, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """The prices (``write``: written once, for queries that read them again) and the labels with an end."""
    p = _prices(spark, folder) if write else prices(spark, folder)
    return p, W.closed_labels(labels(spark, folder), p, KEYS).where("t1 is not null and t1 >= t0")


@query("concurrency", f"{_PL}, {_CLOSED}, {_CONC} SELECT instrument, ts, n AS n_labels FROM conc")
def concurrency(spark: SparkSession, folder: str) -> DataFrame:
    p, l = _closed(spark, folder)
    return W.concurrency(p, l, KEYS).select("instrument", "ts", "n_labels")


@query("average_uniqueness", f"{_PL}, {_CLOSED}, {_CONC} SELECT c.instrument, c.t0, c.t1, round(avg(1.0 / n), 7) AS uniqueness FROM (SELECT DISTINCT * FROM closed WHERE t1 >= t0) c LEFT JOIN conc k ON k.instrument = c.instrument AND k.ts BETWEEN c.t0 AND c.t1 GROUP BY 1, 2, 3")
def average_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    p, l = _closed(spark, folder)
    return W.average_uniqueness(p, l, KEYS).withColumn("uniqueness", F.round("uniqueness", 7))


@query("weights_by_return", f"""{_PL}, {_CLOSED}, {_CONC}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY ts)) AS ret FROM conc),
w AS (SELECT c.instrument, c.t0, c.t1, abs(coalesce(sum(ret / n), 0)) AS w FROM (SELECT DISTINCT * FROM closed WHERE t1 >= t0) c LEFT JOIN r k ON k.instrument = c.instrument AND k.ts BETWEEN c.t0 AND c.t1 GROUP BY 1, 2, 3)
SELECT instrument, t0, t1, round(w * count(*) OVER p / nullif(sum(w) OVER p, 0), 5) AS weight FROM w WINDOW p AS (PARTITION BY instrument)""")
def weights_by_return(spark: SparkSession, folder: str) -> DataFrame:
    p, l = _closed(spark, folder)
    return W.weights_by_return(p, l, KEYS).withColumn("weight", F.round("weight", 5))


@query("weights_by_time_decay", f"""{_PL}, {_CLOSED}, {_CONC}, u AS (SELECT c.instrument, c.t0, c.t1, avg(1.0 / n) AS u FROM (SELECT DISTINCT * FROM closed WHERE t1 >= t0) c JOIN conc k ON k.instrument = c.instrument AND k.ts BETWEEN c.t0 AND c.t1 GROUP BY 1, 2, 3),
x AS (SELECT *, sum(u) OVER (PARTITION BY instrument ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS s, sum(u) OVER (PARTITION BY instrument) AS z FROM u)
SELECT instrument, t0, round(greatest(1 - 0.5 / z * z + 0.5 / z * s, 0), 6) AS weight FROM x""")
def weights_by_time_decay(spark: SparkSession, folder: str) -> DataFrame:
    p, l = _closed(spark, folder)
    return W.weights_by_time_decay(W.average_uniqueness(p, l, KEYS), KEYS, 0.5).withColumn("weight", F.round("weight", 6))


@query("sequential_bootstrap")
def sequential_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    _, l = _closed(spark, folder, write=False)
    return W.sequential_bootstrap(l, KEYS, n=20, samples=2)


_FOLDS = "ranked AS (SELECT instrument, t0, t1, row_number() OVER (PARTITION BY instrument ORDER BY t0, t1) - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM closed WHERE t1 >= t0), folded AS (SELECT *, CASE WHEN pos < (n % 4) * (n // 4 + 1) THEN pos // (n // 4 + 1) ELSE n % 4 + (pos - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS fold FROM ranked)"
_SPANS = "spans AS (SELECT f.instrument, f.fold, f.t1 AS s, (SELECT t1 FROM folded g WHERE g.instrument = f.instrument AND g.pos = CASE WHEN x.b + 1 < f.n THEN least(x.b + CAST(floor(f.n * 0.05) AS BIGINT), f.n - 1) ELSE x.b END) AS e FROM folded f JOIN (SELECT instrument, fold, min(pos) AS a, max(pos) AS b FROM folded GROUP BY 1, 2) x ON x.instrument = f.instrument AND x.fold = f.fold AND x.a = f.pos)"
_HIT = "((s.s <= f.t0 AND f.t0 <= s.e) OR (s.s <= f.t1 AND f.t1 <= s.e) OR (f.t0 <= s.s AND s.e <= f.t1))"


@query("purged_kfold", f"""{_PL}, {_CLOSED}, {_FOLDS}, {_SPANS}
SELECT f.instrument, CAST(s.fold AS INTEGER) AS split, f.t0, f.t1, CASE WHEN f.fold = s.fold THEN 'test' ELSE 'train' END AS role FROM folded f JOIN spans s ON s.instrument = f.instrument WHERE f.fold = s.fold OR NOT {_HIT}""")
def purged_kfold(spark: SparkSession, folder: str) -> DataFrame:
    _, l = _closed(spark, folder, write=False)
    return C.purged_folds(l.select("instrument", "t0", "t1"), KEYS, 4, 0.05)


@query("purge", f"""{_PL}, {_CLOSED}, s AS (SELECT instrument, min(t0) + 86400000000 AS s, min(t0) + 5 * 86400000000 AS e FROM closed GROUP BY 1)
SELECT f.instrument, f.t0, f.t1 FROM closed f WHERE f.t1 >= f.t0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.instrument = f.instrument AND {_HIT})""")
def purge(spark: SparkSession, folder: str) -> DataFrame:
    _, l = _closed(spark, folder, write=False)
    l = l.select("instrument", "t0", "t1")
    tests = l.groupBy("instrument").agg((F.min("t0") + 24 * HOUR).alias("start"), (F.min("t0") + 120 * HOUR).alias("end"))
    return C.purge(l, tests, KEYS)


@query("combinatorial_kfold", f"""{_PL}, {_CLOSED}, {_FOLDS}, {_SPANS}, c AS (SELECT * FROM (VALUES (0, [0, 1]), (1, [0, 2]), (2, [0, 3]), (3, [1, 2]), (4, [1, 3]), (5, [2, 3])) AS v(split, tests))
SELECT f.instrument, c.split, f.t0, f.t1, CASE WHEN list_contains(c.tests, f.fold) THEN 'test' ELSE 'train' END AS role FROM folded f, c
WHERE list_contains(c.tests, f.fold) OR NOT EXISTS (SELECT 1 FROM spans s WHERE s.instrument = f.instrument AND list_contains(c.tests, s.fold) AND {_HIT})""")
def combinatorial_kfold(spark: SparkSession, folder: str) -> DataFrame:
    _, l = _closed(spark, folder, write=False)
    return C.combinatorial_folds(l.select("instrument", "t0", "t1"), KEYS, 4, 2, 0.05).drop("tests")


# Bet sizing. Probabilities are those of train; signals live for a day.

_TRAIN = "p AS (SELECT instrument, seq, epoch_us(ts) AS t0, epoch_us(ts) + 86400000000 AS t1, prob, CASE WHEN pmodel > 0 THEN 1.0 ELSE -1.0 END AS side FROM train WHERE prob > 0 AND prob < 1)"


def _bets(spark: SparkSession, folder: str) -> DataFrame:
    t0 = F.unix_micros("ts")
    return table(spark, folder, "train").where("prob > 0 and prob < 1 and ts is not null").select("instrument", "seq", t0.alias("t0"), (t0 + 24 * HOUR).alias("t1"), "prob", F.when(F.col("pmodel") > 0, 1.0).otherwise(-1.0).alias("side"))


_ZP = "((prob - 0.5) / sqrt(prob * (1 - prob)))"


@query("bet_size_probability", f"WITH {_TRAIN}, s AS (SELECT *, side * (2 * {norm_cdf_sql(_ZP)} - 1) AS g FROM p) SELECT instrument, seq, round(CASE WHEN {norm_cdf_sql(_ZP)} < 0.5 THEN 0.0 ELSE {norm_cdf_sql(_ZP)} END, 6) AS clipped, round(g, 6) AS signal FROM s")
def bet_size_probability(spark: SparkSession, folder: str) -> DataFrame:
    b = _bets(spark, folder)
    return b.select("instrument", "seq", F.round(Z.clipped_cdf_size(F.col("prob")), 6).alias("clipped"), F.round(Z.signal(F.col("prob"), 2, F.col("side")), 6).alias("signal"))


@query("average_active_signals", f"""WITH {_TRAIN}, s AS (SELECT *, side * (2 * {norm_cdf_sql(_ZP)} - 1) AS g FROM p), a AS (SELECT instrument, t0 AS at FROM s UNION SELECT instrument, t1 FROM s)
SELECT a.instrument, a.at, round(coalesce(avg(s.g), 0), 5) AS bet_size FROM a LEFT JOIN s ON s.instrument = a.instrument AND s.t0 <= a.at AND a.at < s.t1 GROUP BY 1, 2""")
def average_active_signals(spark: SparkSession, folder: str) -> DataFrame:
    return Z.bet_size_from_probability(_bets(spark, folder), KEYS, averaged=True, prediction="side").withColumn("bet_size", F.round("bet_size", 5))


@query("discrete_signal", f"WITH {_TRAIN} SELECT instrument, seq, round(greatest(least(round_even(prob / 0.1, 0) * 0.1, 1), -1), 6) AS d FROM p")
def discrete_signal(spark: SparkSession, folder: str) -> DataFrame:
    return _bets(spark, folder).select("instrument", "seq", F.round(Z.discrete(F.col("prob"), 0.1), 6).alias("d"))


_SIDES = "c AS (SELECT a.instrument, a.seq, a.t0, count(CASE WHEN b.side > 0 THEN 1 END) AS active_long, count(CASE WHEN b.side < 0 THEN 1 END) AS active_short FROM p a JOIN p b ON b.instrument = a.instrument AND b.t0 <= a.t0 AND b.t1 > a.t0 GROUP BY 1, 2, 3)"


@query("budget_size", f"WITH {_TRAIN}, {_SIDES} SELECT instrument, seq, active_long, active_short, round(coalesce(active_long / nullif(max(active_long) OVER w, 0), 0) - coalesce(active_short / nullif(max(active_short) OVER w, 0), 0), 6) AS bet_size FROM c WINDOW w AS (PARTITION BY instrument)")
def budget_size(spark: SparkSession, folder: str) -> DataFrame:
    return Z.budget_size(_bets(spark, folder), KEYS).select("instrument", "seq", "active_long", "active_short", F.round("bet_size", 6).alias("bet_size"))


_SW = repr(Z.calibrate(10, 0.95))


@query("dynamic_size", f"""WITH {DAILY_SQL}, d AS (SELECT instrument, day, c AS m_p, c + (o - c) * 3 AS f, CAST(day % 21 AS INTEGER) - 10 AS pos FROM daily), e AS (SELECT *, (f - m_p) / sqrt({_SW} + (f - m_p) * (f - m_p)) AS bet_size FROM d), t AS (SELECT *, CAST(trunc(bet_size * 100) AS INTEGER) AS t_pos FROM e)
SELECT instrument, day, round(bet_size, 6) AS bet_size, t_pos, CASE WHEN t_pos <> pos THEN round(coalesce(list_sum([f - (j / 100.0) * sqrt({_SW} / (1 - (j / 100.0) * (j / 100.0))) FOR j IN range(abs(pos + CAST(sign(t_pos - pos) AS INTEGER)), abs(t_pos + 1))]), 0) / abs(t_pos - pos), 5) END AS l_p FROM t""")
def dynamic_size(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder).select("instrument", "day", F.col("c").alias("m_p"), (F.col("c") + (F.col("o") - F.col("c")) * 3).alias("f"), (F.expr("cast(day % 21 as int)") - 10).alias("pos"), F.lit(100).alias("max_pos"))
    return Z.dynamic_size(d).select("instrument", "day", F.round("bet_size", 6).alias("bet_size"), "t_pos", F.round("l_p", 5).alias("l_p"))


@query("power_size", f"WITH {_TRAIN}, x AS (SELECT *, 2 * prob - 1 AS d FROM p) SELECT instrument, seq, round(sign(d) * pow(abs(d), 2.0), 6) AS size, CAST(trunc(sign(d) * pow(abs(d), 2.0) * 50) AS INTEGER) AS target, round(1.0 - sign(d) * pow(abs(d), 0.5), 6) AS price FROM x")
def power_size(spark: SparkSession, folder: str) -> DataFrame:
    d = 2 * F.col("prob") - 1
    return _bets(spark, folder).select("instrument", "seq", F.round(Z.size(d, 2.0, "power"), 6).alias("size"), Z.target_position(2.0, d, F.lit(0.0), F.lit(50), "power").alias("target"), F.round(Z.inverse_price(F.lit(1.0), 2.0, d, "power"), 6).alias("price"))


@query("kelly", f"WITH {_TRAIN} SELECT instrument, seq, round(prob / 0.8 - (1 - prob) / 1.2, 9) AS kelly, round(greatest(least(prob / 0.8 - (1 - prob) / 1.2, 1), 0), 9) AS clipped FROM p")
def kelly(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("prob")
    return _bets(spark, folder).select("instrument", "seq", F.round(Z.kelly(p, 1.2, -0.8), 9).alias("kelly"), F.round(Z.clipped_kelly(p, 1.2, -0.8), 9).alias("clipped"))


_EDGES = " + ".join(f"CASE WHEN prob > (SELECT quantile_cont(prob, {i / 10}) FROM t) THEN 1 ELSE 0 END" for i in range(1, 10))


@query("decile_calibration", f"""WITH t AS (SELECT prob, target, target_rets AS r FROM train WHERE prob BETWEEN 0 AND 1 AND target_rets BETWEEN -1 AND 1)
SELECT {_EDGES} AS bucket, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(target), 6) AS hit_rate, round(avg(CASE WHEN r > 0 THEN r END), 6) AS mean_win, round(avg(CASE WHEN r <= 0 THEN r END), 6) AS mean_loss FROM t GROUP BY 1""")
def decile_calibration(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "train").where("prob between 0 and 1 and target_rets between -1 and 1")
    out = Z.decile_calibration(t, "prob", "target", "target_rets")
    return out.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("mean_prob", "hit_rate", "mean_win", "mean_loss")])


@query("ecdf_size", """WITH t AS (SELECT instrument, seq, prob FROM train WHERE prob BETWEEN 0 AND 1), c AS (SELECT prob, count(*) AS n FROM t GROUP BY 1), e AS (SELECT prob, sum(n) OVER (ORDER BY prob) / sum(n) OVER () AS s FROM c)
SELECT instrument, seq, round(s, 6) AS bet_size FROM t JOIN e USING (prob)""")
def ecdf_size(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "train").where("prob between 0 and 1")
    return Z.ecdf_size(t, t.select("instrument", "seq", "prob"), "prob").select("instrument", "seq", F.round("bet_size", 6).alias("bet_size"))
