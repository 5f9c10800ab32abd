"""Queries of cleaning helpers, technical indicators, fractional differences and the per-bar feature table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.fold import fold
from barloom.functions import entropy as E
from barloom.functions import frames as C
from barloom.joins import asof_join
from barloom.numeric import models as N
from barloom.operators import bars as B
from barloom.operators import betsize as Z
from barloom.operators import labeling as L
from barloom.operators import microstructure as M
from barloom.operators import technical as T
from barloom.ordering import running
from barloom.plans.features import YEAR, _days, ewm_sql, lag_sql, r6, roll_sql, steps
from barloom.plans.inputs import DAILY_SQL, PRICES_SQL, SIGNS_SQL, daily, prices, ticks
from barloom.plans.registry import query, table

KEYS = ["instrument"]


@query("keep_first_last", """SELECT instrument, epoch_us(date_time) AS ts, arg_min(close, seq) AS first_close, arg_max(close, seq) AS last_close FROM bars WHERE date_time IS NOT NULL AND close IS NOT NULL GROUP BY 1, 2""")
def keep_first_last(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "bars").where("date_time is not null and close is not null").select("instrument", F.unix_micros("date_time").alias("ts"), "seq", "close")
    first, last = C.keep_one(b, ["instrument", "ts"], "seq"), C.keep_one(b, ["instrument", "ts"], "seq", last=True)
    return first.select("instrument", "ts", F.col("close").alias("first_close")).join(last.select("instrument", "ts", F.col("close").alias("last_close")), ["instrument", "ts"])


@query("fill_forward", """SELECT instrument, seq, round(last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date_time, seq ROWS UNBOUNDED PRECEDING), 6) AS close,
  round(last_value(CASE WHEN volume <> 0 THEN volume END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date_time, seq ROWS UNBOUNDED PRECEDING), 6) AS volume FROM bars WHERE date_time IS NOT NULL""")
def fill_forward(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "bars").where("date_time is not null").select("instrument", "seq", "date_time", "close", "volume")
    out = C.zeros_to_previous(C.fill_forward(b, KEYS, "date_time", ["close"], ["seq"]), KEYS, "date_time", "volume", ["seq"])
    return out.select("instrument", "seq", F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"))


@query("fill_backward", "SELECT instrument, seq, round(first_value(prob IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS prob FROM (SELECT instrument, seq, CASE WHEN NOT isnan(prob) AND NOT isinf(prob) THEN prob END AS prob FROM train)")
def fill_backward(spark: SparkSession, folder: str) -> DataFrame:
    t = C.without_infinities(table(spark, folder, "train").select("instrument", "seq", "prob"), ["prob"])
    return C.fill_backward(t, KEYS, "seq", ["prob"], cell_us=100_000).select("instrument", "seq", F.round("prob", 6).alias("prob"))


@query("align_backfill", f"WITH {PRICES_SQL} SELECT e.instrument, e.ts, p.close FROM (SELECT DISTINCT instrument, epoch_us(t0) AS ts FROM triple_barrier_events WHERE t0 IS NOT NULL) e ASOF LEFT JOIN prices p ON p.instrument = e.instrument AND p.ts >= e.ts")
def align_backfill(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "triple_barrier_events").where("t0 is not null").select("instrument", F.unix_micros("t0").alias("ts")).distinct()
    return C.align(e, prices(spark, folder), KEYS, "ts", ["close"], backfill=True)


@query("bollinger", steps(f"{roll_sql('avg', 'c', 20)} AS m, {roll_sql('stddev_pop', 'c', 20)} AS d", "m AS band_mid, m + 2 * d AS band_high, m - 2 * d AS band_low", select=r6("band_mid", "band_high", "band_low")))
def bollinger(spark: SparkSession, folder: str) -> DataFrame:
    return T.bollinger(_days(spark, folder)).rows("instrument", "day", *[F.round(c, 6).alias(c) for c in ("band_mid", "band_high", "band_low")])


@query("money_flow_index", steps("(h + l + c) / 3 AS tp", f"{lag_sql('tp')} AS pt, tp * v AS mf", "CASE WHEN tp > pt THEN mf ELSE 0.0 END AS up, CASE WHEN tp < pt THEN mf ELSE 0.0 END AS dn", f"{roll_sql('sum', 'up', 14)} AS su, {roll_sql('sum', 'dn', 14)} AS sd",
    "CASE WHEN sd = 0 THEN CASE WHEN su IS NOT NULL THEN 100.0 END ELSE 100 - 100 / (1 + su / sd) END AS mfi", select="round(mfi, 5) AS mfi"))
def money_flow_index(spark: SparkSession, folder: str) -> DataFrame:
    return T.money_flow_index(_days(spark, folder)).rows("instrument", "day", F.round("mfi", 5).alias("mfi"))


@query("ease_of_movement", steps(f"(h - {lag_sql('h')} + l - {lag_sql('l')}) * (h - l) / (2 * v) * 1e8 AS eom", f"{roll_sql('avg', 'eom', 14)} AS eom_mean", select="round(eom, 4) AS eom, round(eom_mean, 4) AS eom_mean"))
def ease_of_movement(spark: SparkSession, folder: str) -> DataFrame:
    return T.ease_of_movement(_days(spark, folder)).rows("instrument", "day", F.round("eom", 4).alias("eom"), F.round("eom_mean", 4).alias("eom_mean"))


@query("rolling_vwap", steps("(h + l + c) / 3 * v AS pv", f"{roll_sql('sum', 'pv', 14)} / {roll_sql('sum', 'v', 14)} AS vwap", select=r6("vwap")))
def rolling_vwap(spark: SparkSession, folder: str) -> DataFrame:
    return T.rolling_vwap(_days(spark, folder)).rows("instrument", "day", F.round("vwap", 6).alias("vwap"))


@query("volume_flows", f"""WITH {DAILY_SQL}, a AS (SELECT *, {lag_sql('c')} AS b FROM daily)
SELECT instrument, day, sum(CASE WHEN c > b THEN v WHEN c < b THEN -v ELSE 0.0 END) OVER w AS obv, round(sum(coalesce(v * (c / b - 1), 0)) OVER w, 4) AS vpt FROM a WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING)""")
def volume_flows(spark: SparkSession, folder: str) -> DataFrame:
    return T.volume_flows(daily(spark, folder), KEYS, "day", cell_us=YEAR).withColumn("vpt", F.round("vpt", 4))


_A, _B = 2 / 26, 2 / 14


@query("true_strength", f"""WITH RECURSIVE {DAILY_SQL}, x AS (SELECT instrument, day, rn, c - lag(c) OVER (PARTITION BY instrument ORDER BY rn) AS d FROM daily),
walk AS (SELECT instrument, day, rn, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS p, NULL::DOUBLE AS q FROM x WHERE rn = 1
  UNION ALL SELECT instrument, day1, rn1, a1, coalesce(b + (a1 - b) * {_B!r}, a1), p1, coalesce(q + (p1 - q) * {_B!r}, p1)
  FROM (SELECT w.*, x.day AS day1, x.rn AS rn1, coalesce(w.a + (x.d - w.a) * {_A!r}, x.d) AS a1, coalesce(w.p + (abs(x.d) - w.p) * {_A!r}, abs(x.d)) AS p1 FROM walk w JOIN x ON x.instrument = w.instrument AND x.rn = w.rn + 1))
SELECT instrument, day, round(100 * b / nullif(q, 0), 5) AS tsi FROM walk""")
def true_strength(spark: SparkSession, folder: str) -> DataFrame:
    return T.true_strength(daily(spark, folder), KEYS, "day", "c", cell_us=YEAR).withColumn("tsi", F.round("tsi", 5))


@query("lagged_day_return", f"WITH {PRICES_SQL}, q AS (SELECT *, ts - 86400000000 AS due FROM prices) SELECT q.instrument, q.ts, round(q.close / p.close - 1, 6) AS ret FROM q ASOF JOIN prices p ON p.instrument = q.instrument AND p.ts < q.due")
def lagged_day_return(spark: SparkSession, folder: str) -> DataFrame:
    p = prices(spark, folder)
    rows = asof_join(p.withColumn("due", F.col("ts") - 86_400_000_000), p.select("instrument", F.col("ts").alias("at"), F.col("close").alias("past")), KEYS, "due", "at", ["past"], exact=False)
    return rows.where("past is not null").select("instrument", "ts", F.round(F.try_divide("close", "past") - 1, 6).alias("ret"))


@query("daily_volatility", f"""WITH {PRICES_SQL}, q AS (SELECT *, ts - 86400000000 AS due FROM prices), r AS (SELECT q.instrument, q.ts AS tm, q.close / p.close - 1 AS x FROM q ASOF JOIN prices p ON p.instrument = q.instrument AND p.ts < q.due),
s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY tm) AS rn FROM r), {ewm_sql('s', 1 - 2 / 101)} SELECT instrument, tm AS ts, round(ewm_std, 6) AS volatility FROM ewm""")
def daily_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return T.daily_volatility(prices(spark, folder), KEYS).withColumn("volatility", F.round("volatility", 6))


@query("expanding_frac_diff", f"""WITH RECURSIVE {DAILY_SQL}, k AS (SELECT 0::BIGINT AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - (k + 1) + 1) / (k + 1) FROM k WHERE k < (SELECT max(rn) FROM daily)),
z AS (SELECT instrument, max(rn) AS n FROM daily GROUP BY 1), t AS (SELECT instrument, n, k, sum(abs(w)) OVER (PARTITION BY instrument ORDER BY k DESC) / sum(abs(w)) OVER (PARTITION BY instrument) AS loss FROM z JOIN k ON k.k < z.n),
s AS (SELECT instrument, count(CASE WHEN loss > 0.3 THEN 1 END) AS skip FROM t GROUP BY 1)
SELECT a.instrument, a.day, round(sum(k.w * b.c), 4) AS frac_diff FROM daily a JOIN s ON s.instrument = a.instrument AND a.rn > s.skip JOIN daily b ON b.instrument = a.instrument AND b.rn <= a.rn JOIN k ON k.k = a.rn - b.rn GROUP BY 1, 2""")
def expanding_frac_diff(spark: SparkSession, folder: str) -> DataFrame:
    return T.expanding_difference(daily(spark, folder), KEYS, "day", "c", 0.4, 0.3).withColumn("frac_diff", F.round("frac_diff", 4))


@query("difference_search")
def difference_search(spark: SparkSession, folder: str) -> DataFrame:
    return T.difference_search(daily(spark, folder).withColumn("x", F.ln("c")), KEYS, "day", "x")


@query("directional_dataset", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, day, rn, c / {lag_sql('c')} - 1 AS r FROM daily)
SELECT instrument, day, round(r, 6) AS r, CASE WHEN lead(r) OVER w > 0 THEN 1 WHEN lead(r) OVER w IS NOT NULL THEN 0 END AS target, round(lead(r) OVER w, 6) AS target_ret, round(lag(r, 1) OVER w, 6) AS lag_1, round(lag(r, 5) OVER w, 6) AS lag_5 FROM r WINDOW w AS (PARTITION BY instrument ORDER BY rn)""")
def directional_dataset(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    s = L.directional_dataset(s.let(r=s.change("c")), "r")
    return s.rows("instrument", "day", "target", *[F.round(c, 6).alias(c) for c in ("r", "target_ret", "lag_1", "lag_5")])


@query("micro_features", f"""WITH {SIGNS_SQL}, t AS (SELECT *, price - lag(price) OVER w AS pd, ln(price / lag(price) OVER w) AS lr, price * volume AS d, (rn - 1) // 10 AS bar FROM signs WINDOW w AS (PARTITION BY instrument ORDER BY rn)),
f AS (SELECT instrument, max(rn) AS tick_num, avg(volume) AS avg_tick_size, sum(sgn) AS tick_rule_sum, sum(d) / sum(volume) AS vwap, sum(volume * sgn * pd) / nullif(sum(CASE WHEN pd IS NOT NULL THEN pow(volume * sgn, 2) END), 0) AS kyle, count(*) AS n FROM t GROUP BY instrument, bar)
SELECT instrument, tick_num, round(avg_tick_size, 6) AS avg_tick_size, tick_rule_sum, round(vwap, 9) AS vwap, round(kyle, 6) AS kyle FROM f WHERE n = 10""")
def micro_features(spark: SparkSession, folder: str) -> DataFrame:
    return _micro(spark, folder).select("instrument", "tick_num", F.round("avg_tick_size", 6).alias("avg_tick_size"), "tick_rule_sum", F.round("vwap", 9).alias("vwap"), F.round("kyle", 6).alias("kyle"))


def _micro(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table of tick bars: sizes, lambdas and the message of tick signs."""
    t = running(ticks(spark, folder), KEYS, "ts", ["seq"], {"before": ("last", "price")}, inclusive=False)
    c = F.col
    pd_, lr, d = c("price") - c("before"), F.ln(F.try_divide("price", "before")), c("price") * c("volume")
    flagged = F.when(c("before").isNotNull(), c("volume") * c("sign"))
    features = [
        B.BarFeature("avg_tick_size", M.average_tick_size(c("volume"))), B.BarFeature("tick_rule_sum", F.sum(c("sign").cast("bigint"))), B.BarFeature("vwap", M.vwap(d, c("volume"))),
        B.BarFeature("kyle", M.slope_through_origin(flagged, pd_)), B.BarFeature("amihud", M.slope_through_origin(F.when(lr.isNotNull(), d), F.abs(lr))), B.BarFeature("hasbrouck", M.slope_through_origin(F.when(lr.isNotNull(), F.sqrt(d) * c("sign")), F.abs(lr))),
        B.BarFeature("message", E.message(["ts", "seq"], E.tick_letter(c("sign")))),
    ]
    return B.bars_with_features(t, B.tick_bars(ticks(spark, folder), threshold=10), features)


@query("micro_feature_entropies")
def micro_feature_entropies(spark: SparkSession, folder: str) -> DataFrame:
    return _micro(spark, folder).select("instrument", "tick_num", "kyle", "amihud", "hasbrouck", *[E.entropy(F.col("message"), m).alias(m) for m in E.MEASURES])


class _RollingPin:
    def __init__(self, window: int) -> None:
        self.window, self.b, self.s = window, [], []

    def feed(self, columns):
        out_ts, out = [], []
        for t, b, s in zip(columns["_ts"].tolist(), columns["b"].tolist(), columns["s"].tolist()):
            self.b, self.s = [*self.b, b][-self.window :], [*self.s, s][-self.window :]
            if len(self.b) == self.window:
                out_ts.append(t)
                out.append(N.informed_trading(np.array(self.b), np.array(self.s)))
        return {"_ts": np.array(out_ts), "pin": np.array(out)} if out else {}

    def finish(self):
        return {}


@query("rolling_informed_trading")
def rolling_informed_trading(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of informed trading over the last 21 days of the whole market's buys and sells."""
    t = B.tick_signs(ticks(spark, folder), KEYS)
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).alias("_ts")
    by_day = t.groupBy(day).agg(F.sum(F.when(F.col("sign") > 0, 1.0).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("sign") < 0, 1.0).otherwise(0.0)).alias("s")).withColumn("market", F.lit(0))
    return fold(by_day, ["market"], ["_ts"], ["_ts", "b", "s"], lambda: _RollingPin(21), "_ts bigint, pin double").select(F.col("_ts").alias("day"), "pin")


@query("sizing_bakeoff")
def sizing_bakeoff(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "train").where("prob between 0 and 1 and target_rets between -1 and 1 and target is not null").select("prob", F.col("target_rets").alias("ret"), F.col("target").cast("double").alias("label"))
    return Z.sizing_bakeoff(t, t, label="label")
