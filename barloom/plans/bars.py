"""Queries of the bar operators over events as ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.plans.inputs import SIGNS_SQL, TICKS_SQL, ticks
from barloom.plans.registry import query

#: Small enough for bars in every series of the test tables.
WARM = B.Expectation(window=40, ticks=8, previous_bars=3, bounds=(4, 40))
WARM_CONSTANT = B.Expectation(window=40, ticks=8, previous_bars=3, constant=True)

_OHLC = "arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(volume) AS volume, sum(CASE WHEN sgn = 1 THEN volume ELSE 0 END) AS cum_buy_volume, count(*) AS cum_ticks, round(sum(price * volume), 4) AS cum_dollar_value"


def _tidy(df: DataFrame) -> DataFrame:
    out = df.withColumns({c: F.round(c, 4) for c in ("cum_dollar_value", "threshold", "cum_theta") if c in df.columns})
    return out.withColumn("date_time", F.unix_micros("date_time")) if dict(out.dtypes)["date_time"] == "timestamp" else out


@query("tick_rule", f"WITH {SIGNS_SQL} SELECT instrument, seq, sgn AS sign FROM signs")
def tick_rule(spark: SparkSession, folder: str) -> DataFrame:
    return B.tick_signs(ticks(spark, folder), ["instrument"]).select("instrument", "seq", F.col("sign").cast("bigint").alias("sign"))


@query("tick_rule_feature", f"WITH {SIGNS_SQL} SELECT instrument, seq, CASE WHEN sgn = 0 THEN 1 ELSE sgn END AS sign FROM signs")
def tick_rule_feature(spark: SparkSession, folder: str) -> DataFrame:
    return B.tick_signs(ticks(spark, folder), ["instrument"], first=1).select("instrument", "seq", F.col("sign").cast("bigint").alias("sign"))


@query("tick_bars", f"WITH {SIGNS_SQL} SELECT instrument, epoch_us(max(ts)) AS date_time, max(rn) AS tick_num, {_OHLC} FROM signs GROUP BY instrument, (rn - 1) // 5 HAVING count(*) = 5")
def tick_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(B.tick_bars(ticks(spark, folder), threshold=5))


@query("time_bars", f"""WITH {SIGNS_SQL}, g AS (SELECT instrument, (epoch_us(ts) // 1000000 // 86400 + 1) * 86400 AS date_time, max(rn) + 1 AS tick_num, {_OHLC} FROM signs GROUP BY 1, 2)
SELECT * FROM g WHERE date_time < (SELECT max(date_time) FROM g AS x WHERE x.instrument = g.instrument)""")
def time_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(B.time_bars(ticks(spark, folder), seconds=86400))


def _threshold_sql(amount: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {SIGNS_SQL}, walk AS (
  SELECT instrument, rn, {amount} AS total, 0 AS bar FROM signs WHERE rn = 1
  UNION ALL SELECT s.instrument, s.rn, CASE WHEN w.total >= {threshold} THEN 0 ELSE w.total END + {amount.replace('price', 's.price').replace('volume', 's.volume')}, w.bar + CASE WHEN w.total >= {threshold} THEN 1 ELSE 0 END
  FROM walk w JOIN signs s ON s.instrument = w.instrument AND s.rn = w.rn + 1)
SELECT s.instrument, epoch_us(max(ts)) AS date_time, max(s.rn) AS tick_num, {_OHLC.replace('rn)', 's.rn)')} FROM signs s JOIN walk w ON s.instrument = w.instrument AND s.rn = w.rn
GROUP BY s.instrument, w.bar HAVING max(w.total) >= {threshold}"""


@query("volume_bars", _threshold_sql("volume", 250))
def volume_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(B.volume_bars(ticks(spark, folder), threshold=250))


@query("dollar_bars", _threshold_sql("price * volume", 10000))
def dollar_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(B.dollar_bars(ticks(spark, folder), threshold=10000))


_AMOUNTS = {"tick": "1.0::DOUBLE", "volume": "volume", "dollar": "price * volume"}


def _tail(values: str, item: str, n: int) -> str:
    return f"list_append({values}, {item})[-{n}:]"


def _ewma_sql(values: str, window: str) -> str:
    w = f"pow(1 - 2 / ({window} + 1.0::DOUBLE), len({values}) - i)"
    return f"(list_sum([v * {w} FOR v, i IN {values}]) / list_sum([{w} FOR v, i IN {values}]))"


def _next_ticks_sql(e: B.Expectation) -> str:
    return "ticks" if e.constant else f"least(greatest({_ewma_sql('lengths1', str(e.previous_bars))}, {e.bounds[0]}), {e.bounds[1]})"


def _bars_of_walk(walk: str, more: str) -> str:
    """The bars between the ticks of ``walk`` that closed one."""
    return f"""{walk}, bar AS (SELECT *, coalesce(lag(rn) OVER (PARTITION BY instrument ORDER BY rn), 0) AS rn0 FROM walk WHERE hit)
SELECT b.instrument, epoch_us(max(s.ts)) AS date_time, b.rn AS tick_num, {_OHLC.replace('rn)', 's.rn)')}, round(max(b.lim), 4) AS threshold, round(max(b.out), 4) AS cum_theta{more}
FROM bar b JOIN signs s ON s.instrument = b.instrument AND s.rn > b.rn0 AND s.rn <= b.rn GROUP BY b.instrument, b.rn"""


def imbalance_sql(metric: str, e: B.Expectation, more: str = "") -> str:
    look = _ewma_sql("recent1", "len(recent1)")
    return _bars_of_walk(f"""WITH RECURSIVE {SIGNS_SQL}, x AS (SELECT instrument, rn, {_AMOUNTS[metric]} * sgn AS x FROM signs),
walk AS (SELECT DISTINCT instrument, 0::BIGINT AS rn, []::DOUBLE[] AS recent, 0 AS seen, 0.0::DOUBLE AS theta, NULL::DOUBLE AS expected, false AS started, {e.ticks}::DOUBLE AS ticks, []::DOUBLE[] AS lengths, 0 AS size, false AS hit, NULL::DOUBLE AS lim, NULL::DOUBLE AS out FROM x
UNION ALL SELECT instrument, rn1, recent1, seen1, CASE WHEN hit1 THEN 0 ELSE theta1 END, CASE WHEN hit1 THEN CASE WHEN seen1 >= ticks1 THEN {look} END ELSE expected1 END, started OR hit1, CASE WHEN hit1 THEN ticks1 ELSE ticks END,
  CASE WHEN hit1 THEN lengths1 ELSE lengths END, CASE WHEN hit1 THEN 0 ELSE size1 END, hit1, lim1, theta1
FROM (SELECT *, {_next_ticks_sql(e)} AS ticks1 FROM (SELECT *, coalesce(abs(theta1) > lim1, false) AS hit1, {_tail('lengths', 'size1::DOUBLE', e.previous_bars)} AS lengths1 FROM (SELECT *, ticks * abs(expected1) AS lim1 FROM (
  SELECT *, CASE WHEN started OR expected IS NOT NULL THEN expected WHEN seen1 >= ceil(ticks) THEN {look} END AS expected1 FROM (
  SELECT w.*, x.rn AS rn1, {_tail('w.recent', 'x.x', e.window)} AS recent1, w.seen + 1 AS seen1, w.theta + x.x AS theta1, w.size + 1 AS size1 FROM walk w JOIN x ON x.instrument = w.instrument AND x.rn = w.rn + 1))))))""", more)  # fmt: skip


def run_sql(metric: str, e: B.Expectation, more: str = "") -> str:
    look = {side: f"CASE WHEN len({side}1) > 0 THEN {_ewma_sql(side + '1', f'len({side}1)')} END" for side in ("up", "down")}
    keep = lambda after, before: f"CASE WHEN hit1 THEN {after} ELSE {before} END"
    return _bars_of_walk(f"""WITH RECURSIVE {SIGNS_SQL}, x AS (SELECT instrument, rn, {_AMOUNTS[metric]} * sgn AS x FROM signs),
walk AS (SELECT DISTINCT instrument, 0::BIGINT AS rn, []::DOUBLE[] AS up, []::DOUBLE[] AS down, 0 AS seen_up, 0 AS seen_down, 0.0::DOUBLE AS theta_up, 0.0::DOUBLE AS theta_down, NULL::DOUBLE AS e_up, NULL::DOUBLE AS e_down, 0 AS buys,
  NULL::DOUBLE AS share, []::DOUBLE[] AS shares, false AS started, {e.ticks}::DOUBLE AS ticks, []::DOUBLE[] AS lengths, 0 AS size, false AS hit, NULL::DOUBLE AS lim, NULL::DOUBLE AS out FROM x
UNION ALL SELECT instrument, rn1, up1, down1, seen_up1, seen_down1, {keep('0', 'theta_up1')}, {keep('0', 'theta_down1')}, {keep(look['up'], 'e_up1')}, {keep(look['down'], 'e_down1')}, {keep('0', 'buys1')},
  {keep(_ewma_sql('shares1', str(e.previous_bars)), 'share1')}, {keep('shares1', 'shares')}, started OR hit1, {keep(_next_ticks_sql(e), 'ticks')}, {keep('lengths1', 'lengths')}, {keep('0', 'size1')}, hit1, lim1, greatest(theta_up1, theta_down1)
FROM (SELECT *, coalesce(greatest(theta_up1, theta_down1) > lim1, false) AS hit1, {_tail('lengths', 'size1::DOUBLE', e.previous_bars)} AS lengths1, {_tail('shares', 'buys1 / size1::DOUBLE', e.previous_bars)} AS shares1 FROM (
  SELECT *, CASE WHEN e_up1 IS NOT NULL AND e_down1 IS NOT NULL THEN ticks * greatest(e_up1 * share1, e_down1 * (1 - share1)) END AS lim1 FROM (
  SELECT *, CASE WHEN first THEN {look['up']} ELSE e_up END AS e_up1, CASE WHEN first THEN {look['down']} ELSE e_down END AS e_down1, CASE WHEN first THEN buys1 / size1::DOUBLE ELSE share END AS share1 FROM (
  SELECT *, NOT started AND (e_up IS NULL OR e_down IS NULL) AND seen_up1 >= ticks AND seen_down1 >= ticks AS first FROM (
  SELECT w.*, x.rn AS rn1, CASE WHEN x > 0 THEN {_tail('w.up', 'x.x', e.window)} ELSE w.up END AS up1, CASE WHEN x < 0 THEN {_tail('w.down', '-x.x', e.window)} ELSE w.down END AS down1, w.seen_up + CASE WHEN x > 0 THEN 1 ELSE 0 END AS seen_up1,
    w.seen_down + CASE WHEN x < 0 THEN 1 ELSE 0 END AS seen_down1, w.theta_up + greatest(x.x, 0) AS theta_up1, w.theta_down + greatest(-x.x, 0) AS theta_down1, w.buys + CASE WHEN x > 0 THEN 1 ELSE 0 END AS buys1, w.size + 1 AS size1
  FROM walk w JOIN x ON x.instrument = w.instrument AND x.rn = w.rn + 1))))))""", more)  # fmt: skip


def _register(name: str, build, expectation: B.Expectation, metric: str, sql) -> None:
    @query(name, sql(metric, expectation))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _tidy(build(ticks(spark, folder), metric, expectation=expectation, trace=True))

    run.__name__ = name


for _metric in B.METRICS:
    for _kind, _e in (("ema", WARM), ("const", WARM_CONSTANT)):
        _register(f"{_kind}_{_metric}_imbalance_bars", B.imbalance_bars, _e, _metric, imbalance_sql)
        _register(f"{_kind}_{_metric}_run_bars", B.run_bars, _e, _metric, run_sql)


@query("quotes_per_timestamp", f"""WITH {SIGNS_SQL} SELECT instrument, epoch_us(ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume,
  sum(CASE WHEN sgn > 0 THEN volume ELSE 0 END) AS buy_volume, sum(CASE WHEN sgn < 0 THEN volume ELSE 0 END) AS sell_volume FROM signs GROUP BY 1, 2""")
def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return B.quotes_per_timestamp(ticks(spark, folder)).withColumn("ts", F.unix_micros("ts"))


@query("resample_last_count", f"""WITH {TICKS_SQL}, g AS (SELECT instrument, epoch_us(ts) // 3600000000 * 3600 AS bucket, arg_max(price, rn) AS last, count(*) AS n FROM ticks GROUP BY 1, 2),
s AS (SELECT instrument, unnest(range(min(bucket), max(bucket) + 3600, 3600)) AS bucket FROM g GROUP BY 1)
SELECT s.instrument, s.bucket, g.last, coalesce(g.n, 0) AS n FROM s LEFT JOIN g ON s.instrument = g.instrument AND s.bucket = g.bucket""")
def resample(spark: SparkSession, folder: str) -> DataFrame:
    return B.resample(ticks(spark, folder), ["instrument"], 3600)


@query("bar_features", f"""WITH {SIGNS_SQL}, b AS (SELECT *, (rn - 1) // 5 AS bar FROM signs)
SELECT instrument, max(rn) AS tick_num, avg(volume) AS avg_tick_size, sum(sgn) AS tick_rule_sum, round(sum(price * volume) / sum(volume), 9) AS vwap FROM b GROUP BY instrument, bar HAVING count(*) = 5""")
def bar_features(spark: SparkSession, folder: str) -> DataFrame:
    t = ticks(spark, folder)
    features = [B.BarFeature("avg_tick_size", F.avg("volume")), B.BarFeature("tick_rule_sum", F.sum(F.col("sign").cast("bigint"))), B.BarFeature("vwap", F.round(F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")), 9))]
    return B.bars_with_features(t, B.tick_bars(t, threshold=5), features).select("instrument", "tick_num", "avg_tick_size", "tick_rule_sum", "vwap")
