"""Queries of rolling features over the daily bars, and of event filters and signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.special import norm_cdf_sql
from barloom.operators import microstructure as M
from barloom.operators import signals as S
from barloom.operators import volatility as V
from barloom.operators.bars import tick_signs
from barloom.ordering import Staged, running
from barloom.plans.inputs import DAILY_SQL, SIGNS_SQL, daily, ticks
from barloom.plans.registry import query, table

#: A year of days is a calendar cell of the daily series.
YEAR = 366


def _days(spark: SparkSession, folder: str, halo: int = 120) -> Staged:
    s = Staged.over(daily(spark, folder), ["instrument"], "day", halo=halo, cell_us=YEAR)
    return s.let(dollar=F.col("c") * F.col("v"))


def _out(s: Staged, *columns: str) -> DataFrame:
    return s.rows("instrument", "day", *[F.round(c, 6).alias(c) for c in columns])


def roll_sql(f: str, x: str, n: int) -> str:
    w = f"(PARTITION BY instrument ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END"


def lag_sql(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY instrument ORDER BY rn)"


def steps(*ctes: str, select: str) -> str:
    """daily, then each list of further columns over the table before."""
    parts, last = [DAILY_SQL], "daily"
    for i, c in enumerate(ctes):
        parts.append(f"s{i} AS (SELECT *, {c} FROM {last})")
        last = f"s{i}"
    return f"WITH {', '.join(parts)} SELECT instrument, day, {select} FROM {last}"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_PAIR_COV = "CASE WHEN count(dq) OVER w20 = 20 THEN covar_samp(dp, dq) OVER w20 END"


@query("roll_measure", f"""WITH {DAILY_SQL}, a AS (SELECT *, c - {lag_sql('c')} AS dp FROM daily), b AS (SELECT *, {lag_sql('dp')} AS dq FROM a),
e AS (SELECT *, 2 * sqrt(abs({_PAIR_COV})) AS roll FROM b WINDOW w20 AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT instrument, day, round(roll, 6) AS roll, round(roll / (c * v) * 1e6, 6) AS roll_impact FROM e""")
def roll_measure(spark: SparkSession, folder: str) -> DataFrame:
    s = M.roll_measure(M.roll_impact(_days(spark, folder)))
    return _out(s.let(roll_impact=F.col("roll_impact") * 1e6), "roll", "roll_impact")


_D = repr(3 - 2 * math.sqrt(2))
_K2 = math.sqrt(8 / math.pi)


@query("high_low_spread", steps(
    f"pow(ln(h / l), 2) AS hl, CASE WHEN rn >= 2 THEN greatest(h, {lag_sql('h')}) END AS h2, CASE WHEN rn >= 2 THEN least(l, {lag_sql('l')}) END AS l2", f"hl + {lag_sql('hl')} AS b2, pow(ln(h2 / l2), 2) AS gamma",
    f"{roll_sql('avg', 'b2', 20)} AS beta", f"{math.sqrt(2) - 1!r} * sqrt(beta) / {_D} - sqrt(gamma / {_D}) AS raw, {2**-0.5 - 1!r} * sqrt(beta) / {_K2 * (3 - 2 * math.sqrt(2))!r} + sqrt(gamma / {_K2**2 * (3 - 2 * math.sqrt(2))!r}) AS vol",
    "CASE WHEN raw < 0 THEN 0.0 ELSE raw END AS alpha, CASE WHEN vol < 0 THEN 0.0 ELSE vol END AS hl_volatility", "2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS spread", select=r6("beta", "gamma", "alpha", "spread", "hl_volatility")))
def high_low_spread(spark: SparkSession, folder: str) -> DataFrame:
    return _out(M.high_low_spread(_days(spark, folder)), "beta", "gamma", "alpha", "spread", "hl_volatility")


def _held(x: str) -> str:
    return f"last_value(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING)"


@query("bar_lambdas", steps(f"c - {lag_sql('c')} AS dc, ln(c / {lag_sql('c')}) AS lr, c * v AS dollar", f"{_held('dc')} AS sd, {_held('lr')} AS sr", "dc / (v * sd) AS k, abs(lr) / dollar AS a, lr / (sr * sqrt(dollar)) AS hb",
    f"1e6 * {roll_sql('avg', 'k', 20)} AS kyle, 1e9 * {roll_sql('avg', 'a', 20)} AS amihud, 1e6 * {roll_sql('avg', 'hb', 20)} AS hasbrouck", select=r6("kyle", "amihud", "hasbrouck")))
def bar_lambdas(spark: SparkSession, folder: str) -> DataFrame:
    s = M.bar_lambdas(_days(spark, folder, 240))
    return _out(s.let(kyle=F.col("kyle") * 1e6, amihud=F.col("amihud") * 1e9, hasbrouck=F.col("hasbrouck") * 1e6), "kyle", "amihud", "hasbrouck")


@query("trade_lambdas", f"""WITH {SIGNS_SQL}, t AS (SELECT *, price - lag(price) OVER (PARTITION BY instrument ORDER BY rn) AS pd, ln(nullif(price, 0) / nullif(lag(price) OVER (PARTITION BY instrument ORDER BY rn), 0)) AS lr, price * volume AS d FROM signs)
SELECT instrument, round(sum(volume * sgn * pd) / sum(CASE WHEN pd IS NOT NULL THEN pow(volume * sgn, 2) END), 6) AS kyle, round(1e6 * sum(d * abs(lr)) / sum(CASE WHEN lr IS NOT NULL THEN d * d END), 4) AS amihud,
  round(1e3 * sum(sqrt(d) * sgn * abs(lr)) / sum(CASE WHEN lr IS NOT NULL THEN d * sgn * sgn END), 4) AS hasbrouck FROM t WHERE pd IS NOT NULL GROUP BY 1""")
def trade_lambdas(spark: SparkSession, folder: str) -> DataFrame:
    t = running(tick_signs(ticks(spark, folder), ["instrument"]), ["instrument"], "ts", ["seq"], {"before": ("last", "price")}, inclusive=False)
    t = t.where(F.col("before").isNotNull()).select("instrument", "sign", "volume", (F.col("price") - F.col("before")).alias("price_diff"), F.ln(F.try_divide("price", "before")).alias("log_ret"), (F.col("price") * F.col("volume")).alias("dollar"))
    out = M.trade_lambdas(t, ["instrument"])
    return out.select("instrument", F.round("kyle", 6).alias("kyle"), F.round(F.col("amihud") * 1e6, 4).alias("amihud"), F.round(F.col("hasbrouck") * 1e3, 4).alias("hasbrouck"))


@query("bulk_volume", steps(f"c - {lag_sql('c')} AS dc", f"{roll_sql('stddev_samp', 'dc', 20)} AS sd", "CASE WHEN sd <> 0 THEN dc / sd END AS x", f"v * {norm_cdf_sql('x')} AS buy_volume", "abs(2 * buy_volume - v) AS imb", f"{roll_sql('avg', 'imb', 5)} / v AS vpin", select="round(buy_volume, 4) AS buy_volume, round(vpin, 6) AS vpin"))
def bulk_volume(spark: SparkSession, folder: str) -> DataFrame:
    s = M.bulk_buy_volume(_days(spark, folder))
    s = M.vpin(s, buy_volume="buy_volume", window=5)
    return s.rows("instrument", "day", F.round("buy_volume", 4).alias("buy_volume"), F.round("vpin", 6).alias("vpin"))


@query("market_depth", f"WITH {DAILY_SQL} SELECT instrument, day, round(CASE WHEN h <> l THEN v / (h - l) END, 4) AS depth FROM daily")
def market_depth_daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).select("instrument", "day", F.round(M.daily_depth(F.col("h"), F.col("l"), F.col("v")), 4).alias("depth"))


@query("book_depth", """SELECT epoch_us(ts) // 3600000000 * 3600 AS bucket, coalesce(sum(CASE WHEN event_type = 'click' THEN value END), 0) AS bid_depth, coalesce(sum(CASE WHEN event_type = 'view' THEN value END), 0) AS ask_depth FROM events GROUP BY 1""")
def book_depth(spark: SparkSession, folder: str) -> DataFrame:
    book = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.market_depth(book, [], "click", "view", 3600, side="event_type", volume="value")


@query("range_volatility", steps(
    f"pow(ln(h / l), 2) / {4 * math.log(2)!r} AS pk, pow(ln(h / l), 2) AS a, pow(ln(c / o), 2) AS b, ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) AS rs, ln(o / {lag_sql('c')}) AS onr, ln(c / o) AS oc",
    f"sqrt({roll_sql('avg', 'pk', 20)}) AS parkinson, 0.5 * {roll_sql('avg', 'a', 21)} - {2 * math.log(2) - 1!r} * {roll_sql('avg', 'b', 21)} AS gk, {roll_sql('avg', 'rs', 21)} AS rsv, pow(onr - {roll_sql('avg', 'onr', 21)}, 2) AS on2, pow(oc - {roll_sql('avg', 'oc', 21)}, 2) AS oc2",
    f"CASE WHEN gk >= 0 THEN sqrt(gk) END AS garman_klass, CASE WHEN rsv >= 0 THEN sqrt(rsv) END AS rogers_satchell, sqrt({roll_sql('avg', 'on2', 21)} + {0.34 / (1.34 + 22 / 20)!r} * {roll_sql('avg', 'oc2', 21)} + {1 - 0.34 / (1.34 + 22 / 20)!r} * (CASE WHEN rsv >= 0 THEN rsv END)) AS yang_zhang",
    select=r6("parkinson", "garman_klass", "rogers_satchell", "yang_zhang")))
def range_volatility(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    for f in (V.parkinson, V.garman_klass, V.rogers_satchell, V.yang_zhang):
        s = f(s)
    return _out(s, "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")


_IE = 0.34 / (1.34 + 22 / 20)


@query("intrinsic_entropy", f"""WITH {DAILY_SQL}, m AS (SELECT d.*, t.total FROM daily d JOIN (SELECT day, sum(v) AS total FROM daily GROUP BY 1) t ON d.day = t.day),
a AS (SELECT *, v / total AS p, {lag_sql('v')} / total AS q, {lag_sql('c')} AS pc FROM m),
b AS (SELECT *, -ln(o / pc) * p * ln(q) AS co, -ln(c / o) * p * ln(p) AS oc, -(ln(o / h) * ln(h / c) + ln(l / o) * ln(l / c)) * p * ln(p) AS oh FROM a)
SELECT instrument, day, round(1000 * abs({roll_sql('avg', 'co', 21)} + {_IE!r} * {roll_sql('avg', 'oc', 21)} + {1 - _IE!r} * {roll_sql('avg', 'oh', 21)}), 6) AS intrinsic_entropy FROM b""")
def intrinsic_entropy(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder)
    d = d.join(d.groupBy("day").agg(F.sum("v").alias("total")), "day")
    s = V.intrinsic_entropy(Staged.over(d, ["instrument"], "day", halo=120, cell_us=YEAR), "total")
    return _out(s.let(intrinsic_entropy=F.col("intrinsic_entropy") * 1000), "intrinsic_entropy")


@query("true_range", steps(f"{lag_sql('c')} AS pc", select="round(greatest(h - l, abs(h - pc), abs(l - pc)), 6) AS true_range"))
def true_range(spark: SparkSession, folder: str) -> DataFrame:
    return _out(V.true_range(_days(spark, folder)), "true_range")


_N = 20


@query("rolling_moments", steps(f"ln(c / {lag_sql('c')}) AS r", f"{roll_sql('avg', 'r', _N)} AS roll_mean, {roll_sql('stddev_samp', 'r', _N)} AS roll_std, {roll_sql('skewness', 'r', _N)} AS roll_skew, {roll_sql('kurtosis', 'r', _N)} AS roll_kurt",
    select="round(roll_mean, 6) AS roll_mean, round(roll_std, 6) AS roll_std, round(roll_skew, 4) AS roll_skew, round(roll_kurt, 4) AS roll_kurt"))
def rolling_moments(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    s = V.rolling_moments(s.let(r=s.log_return("c")), "r", _N)
    return s.rows("instrument", "day", F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_std", 6).alias("roll_std"), F.round("roll_skew", 4).alias("roll_skew"), F.round("roll_kurt", 4).alias("roll_kurt"))


_W = V.fixed_width_weights(0.4, 0.01)


@query("frac_diff", steps(select="round(" + " + ".join(f"({float(w)!r}) * {lag_sql('c', k) if k else 'c'}" for k, w in enumerate(_W)) + ", 6) AS frac_diff"))
def frac_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _out(V.fixed_width_difference(_days(spark, folder), "c", 0.4, 0.01), "frac_diff")


@query("z_score_filter", steps(f"c >= {roll_sql('avg', 'c', 20)} + 2.0 * {roll_sql('stddev_samp', 'c', 20)} AS event", select="c") + " WHERE event")
def z_score_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.z_score_events(_days(spark, folder), "c", 20, 20, 2.0).rows("instrument", "day", "c", "event").where("event").drop("event")


def cusum_sql(source: str, threshold: float) -> str:
    """The walk over ``source`` (instrument, tm, rn, x)."""
    return f"""moves AS (SELECT *, x - lag(x) OVER (PARTITION BY instrument ORDER BY rn) AS d FROM {source}),
walk AS (SELECT instrument, tm, rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS direction FROM moves WHERE rn = 1
  UNION ALL SELECT instrument, tm, rn, CASE WHEN b >= -{threshold} AND a > {threshold} THEN 0 ELSE a END, CASE WHEN b < -{threshold} THEN 0 ELSE b END, CASE WHEN b < -{threshold} THEN -1 WHEN a > {threshold} THEN 1 ELSE 0 END
  FROM (SELECT m.instrument, m.tm, m.rn, greatest(0, w.up + m.d) AS a, least(0, w.down + m.d) AS b FROM walk w JOIN moves m ON m.instrument = w.instrument AND m.rn = w.rn + 1))"""


def dynamic_z_sql(source: str, lag: int, threshold: float, influence: float) -> str:
    """The walk over ``source`` (instrument, tm, rn, x)."""
    far = f"(n >= {lag + 1} AND abs(x1 - mean) > {threshold} * std)"
    return f"""walk AS (SELECT DISTINCT instrument, NULL::BIGINT AS tm, 0::BIGINT AS rn, []::DOUBLE[] AS recent, 0 AS n, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, 0 AS signal FROM {source}
  UNION ALL SELECT instrument, tm1, rn1, list_append(recent, CASE WHEN {far} THEN {influence} * x1 + {1 - influence!r} * recent[-1] ELSE x1 END)[-{lag}:], n + 1,
    CASE WHEN n >= {lag} THEN list_avg(recent) END, CASE WHEN n >= {lag} THEN list_stddev_pop(recent) END, CASE WHEN {far} THEN CASE WHEN x1 > mean THEN 1 ELSE -1 END ELSE 0 END
  FROM (SELECT w.*, s.tm AS tm1, s.rn AS rn1, s.x AS x1 FROM walk w JOIN {source} s ON s.instrument = w.instrument AND s.rn = w.rn + 1))"""


@query("cusum_filter", f"WITH RECURSIVE {DAILY_SQL}, s AS (SELECT instrument, day AS tm, rn, ln(c) AS x FROM daily), {cusum_sql('s', 0.05)} SELECT instrument, tm AS day, direction FROM walk WHERE direction <> 0")
def cusum_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.cusum_events(daily(spark, folder).withColumn("x", F.ln("c")), ["instrument"], "day", "x", 0.05)


@query("dynamic_z_score", f"WITH RECURSIVE {DAILY_SQL}, s AS (SELECT instrument, day AS tm, rn, c AS x FROM daily), {dynamic_z_sql('s', 20, 3.0, 0.3)} SELECT instrument, tm AS day, signal FROM walk WHERE rn > 0")
def dynamic_z_score(spark: SparkSession, folder: str) -> DataFrame:
    return S.dynamic_z_score(daily(spark, folder), ["instrument"], "day", "c", 20, 3.0, 0.3)


@query("rsi", f"""WITH RECURSIVE {DAILY_SQL}, x AS (SELECT instrument, day, rn, c - lag(c) OVER (PARTITION BY instrument ORDER BY rn) AS d FROM daily),
walk AS (SELECT instrument, day, rn, 0.0::DOUBLE AS u, 0.0::DOUBLE AS w FROM x WHERE rn = 1
  UNION ALL SELECT x.instrument, x.day, x.rn, k.u * 13 / 14 + greatest(x.d, 0) / 14, k.w * 13 / 14 + greatest(-x.d, 0) / 14 FROM walk k JOIN x ON x.instrument = k.instrument AND x.rn = k.rn + 1)
SELECT instrument, day, CASE WHEN rn >= 14 THEN round(CASE WHEN w = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / w) END, 6) END AS rsi FROM walk""")
def rsi(spark: SparkSession, folder: str) -> DataFrame:
    return V.rsi(daily(spark, folder), ["instrument"], "day", "c", cell_us=YEAR).withColumn("rsi", F.round("rsi", 6))


@query("candle_targets", steps(f"{lag_sql('o')} AS o1, {lag_sql('h')} AS h1, {lag_sql('l')} AS l1, {lag_sql('c')} AS c1", "CASE WHEN c1 < o1 THEN (h1 + 2 * l1 + c1) / 2 WHEN c1 > o1 THEN (2 * h1 + l1 + c1) / 2 WHEN c1 = o1 THEN (h1 + l1 + 2 * c1) / 2 END AS base",
    "base - h1 AS low_target, base - l1 AS high_target", "CASE WHEN h > high_target THEN 1 WHEN l < low_target THEN -1 WHEN base IS NOT NULL THEN 0 END AS label", select=r6("base", "low_target", "high_target") + ", label"))
def candle_targets(spark: SparkSession, folder: str) -> DataFrame:
    s = S.candle_targets(_days(spark, folder))
    return s.rows("instrument", "day", *[F.round(c, 6).alias(c) for c in ("base", "low_target", "high_target")], "label")


@query("pressure", steps(select="round((h - o) / o, 6) AS bull, round((o - l) / o, 6) AS bear"))
def pressure(spark: SparkSession, folder: str) -> DataFrame:
    return _out(S.pressure(_days(spark, folder)), "bull", "bear")


@query("crossover_strategy", steps(f"c / {lag_sql('c')} - 1 AS r, {roll_sql('avg', 'c', 5)} AS f, {roll_sql('avg', 'c', 20)} AS s", f"CASE WHEN f > s THEN 1.0 WHEN f <= s THEN -1.0 END AS signal, {roll_sql('stddev_samp', 'r', 22)} AS vol",
    f"greatest(least(CASE WHEN vol <> 0 THEN 0.1 / (vol * {252**0.5!r}) ELSE 2.0 END, 2.0), 0.0) AS scale", "signal * scale AS pos", f"{lag_sql('pos')} AS held", "abs(pos - held) AS turnover", "turnover * 0.001 AS cost", "held * r - cost AS net_return",
    select=r6("signal", "turnover", "cost", "net_return")))
def crossover_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return _out(S.crossover_strategy(_days(spark, folder)), "signal", "turnover", "cost", "net_return")


def ewm_sql(source: str, q: float) -> str:
    """Mean and bias-corrected deviation with adjusted weights q ** age, over ``source`` (instrument, tm, rn, x) without nulls."""
    return f"""pairs AS (SELECT a.instrument, a.tm, b.x, pow({q!r}, a.rn - b.rn) AS w FROM {source} a JOIN {source} b ON b.instrument = a.instrument AND b.rn <= a.rn),
means AS (SELECT *, sum(w * x) OVER k / sum(w) OVER k AS m FROM pairs WINDOW k AS (PARTITION BY instrument, tm)),
ewm AS (SELECT instrument, tm, max(m) AS ewm_mean, CASE WHEN count(*) > 1 THEN sqrt(sum(w * (x - m) * (x - m)) / sum(w) * pow(sum(w), 2) / (pow(sum(w), 2) - sum(w * w))) END AS ewm_std FROM means GROUP BY 1, 2)"""


@query("daily_ewm_volatility", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, day AS tm, c / {lag_sql('c')} - 1 AS x FROM daily), s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY tm) AS rn FROM r WHERE x IS NOT NULL), {ewm_sql('s', 1 - 2 / 101)}
SELECT instrument, tm AS day, round(ewm_mean, 6) AS ewm_mean, round(ewm_std, 6) AS ewm_std FROM ewm""")
def daily_ewm_volatility(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    returns = s.let(r=s.change("c")).rows("instrument", "day", "r").where("r is not null")
    return V.ewm(returns, ["instrument"], "day", "r", span=100, cell_us=YEAR).withColumns({c: F.round(c, 6) for c in ("ewm_mean", "ewm_std")})


@query("futures_roll", f"""WITH {DAILY_SQL}, d AS (SELECT *, 'C' || (day // 90) AS sec FROM daily), g AS (SELECT *, CASE WHEN lag(sec) OVER (PARTITION BY instrument ORDER BY day) <> sec THEN o - c ELSE 0 END AS x FROM d)
SELECT instrument, day, round(sum(x) OVER (PARTITION BY instrument ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS gap FROM g""")
def futures_roll(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder).select("instrument", "day", F.col("o").alias("open"), F.col("c").alias("close"), F.concat(F.lit("C"), F.expr("day div 90").cast("string")).alias("security"))
    out = S.futures_roll_gaps(d.withColumn("current_security", F.col("security")), ["instrument"], "day")
    return out.withColumn("gap", F.round("gap", 6))


@query("etf_trick", f"""WITH RECURSIVE {DAILY_SQL}, p AS (SELECT instrument % 20 AS basket, day AS ts, instrument AS security, o, c FROM daily WHERE c > 0 AND o > 0), t AS (SELECT basket, ts, row_number() OVER (PARTITION BY basket ORDER BY ts) AS rn FROM (SELECT DISTINCT basket, ts FROM p)),
g AS (SELECT t.basket, t.ts, t.rn, list(p.o ORDER BY m.security) AS o, list(p.c ORDER BY m.security) AS c, list(CASE WHEN p.c IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END ORDER BY m.security) AS held FROM t JOIN (SELECT DISTINCT basket, security FROM p) m USING (basket) LEFT JOIN p ON p.basket = t.basket AND p.ts = t.ts AND p.security = m.security GROUP BY 1, 2, 3),
n AS (SELECT *, lead(o) OVER (PARTITION BY basket ORDER BY rn) AS nxt FROM g), u AS (SELECT *, [CASE WHEN held[i] > 0 THEN 1 / list_sum(held) / nxt[i] END FOR i IN range(1, len(held) + 1)] AS unit FROM n),
walk AS (SELECT basket, ts, rn, 1.0::DOUBLE AS value, unit AS h, NULL::DOUBLE[] AS weights, false AS changed, c FROM u WHERE rn = 1
  UNION ALL SELECT basket, ts1, rn1, value + coalesce(list_sum([h1[i] * (c1[i] - CASE WHEN changed THEN o1[i] ELSE c[i] END) FOR i IN range(1, len(c1) + 1)]), 0), h1, held1, weights IS NULL OR weights <> held1, c1
  FROM (SELECT w.*, u.ts AS ts1, u.rn AS rn1, u.c AS c1, u.o AS o1, u.held AS held1, CASE WHEN w.changed THEN [v * w.value FOR v IN u.unit] ELSE w.h END AS h1 FROM walk w JOIN u ON u.basket = w.basket AND u.rn = w.rn + 1))
SELECT basket, ts, round(value, 6) AS value FROM walk""")
def etf_trick(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder).where("c > 0 and o > 0")
    # Baskets of the instruments with the same last digits; equal weights that change with the members present.
    panel = d.select(F.expr("instrument % 20").alias("basket"), F.col("day").alias("ts"), F.col("instrument").alias("security"), F.col("o").alias("open"), F.col("c").alias("close"), F.lit(1.0).alias("alloc"), F.lit(0.0).alias("cost"), F.lit(1.0).alias("rate"))
    return S.etf_trick(panel, "basket").withColumn("value", F.round("value", 6))
