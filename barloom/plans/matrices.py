"""Queries of covariance treatments, clusters, views, the critical line, Kalman states, indicator matrices, files and mapped functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import entropy as E
from barloom.functions.selection import exact_quantiles
from barloom.operators import backtest as B
from barloom.operators import bars as R
from barloom.operators import distance as D
from barloom.operators import mapping
from barloom.operators import matrices as M
from barloom.operators import signals as S
from barloom.operators import weights as W
from barloom.plans.features import _days, lag_sql
from barloom.plans.inputs import DAILY_SQL, LABELS_SQL, PRICES_SQL, SIGNS_SQL, TICKS_SQL, daily, labels, ticks
from barloom.plans.labels import _CLOSED, _closed
from barloom.plans.models import _panel_returns
from barloom.plans.registry import query, table
from barloom.plans.statistics import _MOMENTS, _PAIRS, _RET, _panel, _returns
from barloom.shared import materialize, shared_folder
from barloom.sources import ticks as files

KEYS = ["instrument"]
_PANEL_RET = """p AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day, c_nationkey AS asset, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT day, asset, ln(x / lag(x) OVER (PARTITION BY asset ORDER BY day)) AS ret FROM p) WHERE ret IS NOT NULL)"""


# Matrices.

_RAW = f"""WITH {_PANEL_RET}, v AS (SELECT asset, stddev_samp(ret) AS sd FROM r GROUP BY 1 HAVING stddev_samp(ret) > 0), c AS (SELECT a.asset AS a, b.asset AS b, covar_samp(a.ret, b.ret) AS c FROM r a JOIN r b ON a.day = b.day GROUP BY 1, 2)
SELECT v.asset AS a, w.asset AS b, round(greatest(least(coalesce(c, 0) / (v.sd * w.sd), 1), -1), 6) AS value FROM v JOIN v w ON v.asset <= w.asset LEFT JOIN c ON c.a = v.asset AND c.b = w.asset"""


def _treated(name: str) -> None:
    @query(f"correlation_{name}", _RAW if name == "raw" else None)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return M.treated_correlation(_panel_returns(spark, folder), "day", "asset", name).withColumn("value", F.round("value", 6))

    run.__name__ = f"correlation_{name}"


for _t in M.TREATMENTS:
    _treated(_t)


@query("noise_edge")
def noise_edge(spark: SparkSession, folder: str) -> DataFrame:
    return M.noise_edge(_panel_returns(spark, folder), "day", "asset")


@query("asset_clusters")
def asset_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return M.asset_clusters(_panel_returns(spark, folder), "day", "asset")


def _line(solution: str, name: str) -> None:
    @query(name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return M.critical_line(_panel_returns(spark, folder), "day", "asset", solution)

    run.__name__ = name


for _solution, _name in (("cla_turning_points", "critical_line_turning_points"), ("max_sharpe", "critical_line_max_sharpe"), ("efficient_frontier", "critical_line_frontier")):
    _line(_solution, _name)


@query("entropy_pooling")
def entropy_pooling(spark: SparkSession, folder: str) -> DataFrame:
    """All daily returns as scenarios, with the views that the mean return is 0.1 % and the mean square what it was."""
    r = _returns(spark, folder).where("abs(ret) < 1")
    square = r.agg(F.avg(F.col("ret") * F.col("ret"))).first()[0]
    return M.pooled_probabilities(r, {"mean": (F.col("ret"), 0.001), "square": (F.col("ret") * F.col("ret"), float(square or 0.0))})[0]


@query("distance_portfolio")
def distance_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    return M.distance_weights(_panel_returns(spark, folder), "day", "asset")


@query("dynamic_portfolio")
def dynamic_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    mus, cov = [[0.02, 0.01, 0.0], [0.0, 0.01, 0.03]], [[0.04, 0.01, 0.0], [0.01, 0.02, 0.0], [0.0, 0.0, 0.03]]
    return M.dynamic_weights(spark, mus, [cov, cov], [[0.001] * 3] * 2, 4)


@query("block_correlation")
def block_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return M.block_market(spark, 20, 4, 2)


@query("block_covariance")
def block_covariance(spark: SparkSession, folder: str) -> DataFrame:
    return M.block_market(spark, 20, 4, 2, correlation=False)


@query("antithetic_regression")
def antithetic_regression(spark: SparkSession, folder: str) -> DataFrame:
    return M.antithetic_regression(spark)


# Series.

_Q = "0.001::DOUBLE"


def _forward_sql(noise: float, slope: float, variance: float) -> str:
    """Table fwd: the filter's states and predictions after each close; rn 0 is the start."""
    r = f"(b00 + {noise}::DOUBLE)"
    return f"""{DAILY_SQL}, n AS (SELECT instrument, max(rn) AS n FROM daily GROUP BY 1),
fwd AS (SELECT DISTINCT instrument, NULL::BIGINT AS day, 0::BIGINT AS rn, 0.0::DOUBLE AS x0, {slope}::DOUBLE AS x1, {variance}::DOUBLE AS p00, 0.0::DOUBLE AS p01, {variance}::DOUBLE AS p11, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS q00, 0.0::DOUBLE AS q01, 0.0::DOUBLE AS q11 FROM daily
  UNION ALL SELECT instrument, day1, rn1, a0 + b00 / {r} * (c - a0), a1 + b01 / {r} * (c - a0), b00 - b00 * b00 / {r}, b01 - b00 * b01 / {r}, b11 - b01 * b01 / {r}, a0, a1, b00, b01, b11
  FROM (SELECT f.instrument, d.day AS day1, d.rn AS rn1, d.c, x0 + x1 AS a0, x1 AS a1, p00 + 2 * p01 + p11 + {_Q} / 4 AS b00, p01 + p11 + {_Q} / 2 AS b01, p11 + {_Q} AS b11 FROM fwd f JOIN daily d ON d.instrument = f.instrument AND d.rn = f.rn + 1))"""


def _backward_sql(more: str, carried: str, end: str) -> str:
    """A step of the smoother from table bwd to the row before."""
    return f"""SELECT instrument, day, rn, x0, x1, x0 + ((p00 + p01) * z11 - p01 * z01) / det * e0 + (p01 * z00 - (p00 + p01) * z01) / det * e1, x1 + ((p01 + p11) * z11 - p11 * z01) / det * e0 + (p11 * z00 - (p01 + p11) * z01) / det * e1, y0, y1, q00, q01, q11{more}
  FROM (SELECT f.*, b.q00 AS z00, b.q01 AS z01, b.q11 AS z11, b.q00 * b.q11 - b.q01 * b.q01 AS det, b.s0 - b.y0 AS e0, b.s1 - b.y1 AS e1{carried} FROM bwd b JOIN fwd f ON f.instrument = b.instrument AND f.rn = b.rn - 1 WHERE f.rn > 0{end})"""


@query("kalman_states", f"""WITH RECURSIVE {_forward_sql(1.0, 1.0, 10.0)},
bwd AS (SELECT f.instrument, day, rn, x0, x1, x0 AS s0, x1 AS s1, y0, y1, q00, q01, q11 FROM fwd f JOIN n ON n.instrument = f.instrument AND rn = n UNION ALL {_backward_sql('', '', '')})
SELECT instrument, day, round(x0, 5) AS level, round(x1, 5) AS slope, round(s0, 5) AS smooth_level, round(s1, 5) AS smooth_slope FROM bwd""")
def kalman_states(spark: SparkSession, folder: str) -> DataFrame:
    out = S.kalman_states(daily(spark, folder), KEYS, "day", "c")
    return out.withColumns({c: F.round(c, 5) for c in ("level", "slope", "smooth_level", "smooth_slope")})


@query("kalman_smoother", f"""WITH RECURSIVE {_forward_sql(5.0, 0.5, 200.0)},
bwd AS (SELECT instrument, day, rn, x0, x1, x0 AS s0, x1 AS s1, y0, y1, q00, q01, q11, rn AS since FROM fwd WHERE rn > 0 UNION ALL {_backward_sql(', since', ', b.since', ' AND b.since - b.rn < 4')})
SELECT b.instrument, b.day, round(s0, 5) AS smoothed, round(s1, 5) AS slope FROM bwd b JOIN n USING (instrument) WHERE since = least(b.rn + 4, n)""")
def kalman_smoother(spark: SparkSession, folder: str) -> DataFrame:
    out = S.kalman_lag_smoother(daily(spark, folder), KEYS, "day", "c")
    return out.withColumns({c: F.round(c, 5) for c in ("smoothed", "slope")})


@query("indicator_matrix", f"""WITH {PRICES_SQL}, {LABELS_SQL}, {_CLOSED}, l AS (SELECT * FROM closed WHERE t1 >= t0), s AS (SELECT instrument, min(t0) AS a, max(t1) AS z FROM l GROUP BY 1),
b AS (SELECT instrument, ts FROM (SELECT instrument, ts FROM prices UNION SELECT instrument, t0 FROM l UNION SELECT instrument, t1 FROM l) JOIN s USING (instrument) WHERE ts BETWEEN a AND z)
SELECT l.instrument, b.ts, l.t0, l.t1 FROM l JOIN b ON b.instrument = l.instrument AND b.ts BETWEEN l.t0 AND l.t1""")
def indicator_matrix(spark: SparkSession, folder: str) -> DataFrame:
    p, l = _closed(spark, folder)
    return W.indicator_rows(p, l, KEYS)


@query("label_uniqueness", f"""WITH {PRICES_SQL}, {LABELS_SQL}, {_CLOSED}, l AS (SELECT * FROM closed WHERE t1 >= t0), s AS (SELECT instrument, min(t0) AS a, max(t1) AS z FROM l GROUP BY 1),
b AS (SELECT instrument, ts FROM (SELECT instrument, ts FROM prices UNION SELECT instrument, t0 FROM l UNION SELECT instrument, t1 FROM l) JOIN s USING (instrument) WHERE ts BETWEEN a AND z),
i AS (SELECT l.instrument, b.ts, l.t0, l.t1, count(*) OVER (PARTITION BY l.instrument, b.ts) AS n FROM l JOIN b ON b.instrument = l.instrument AND b.ts BETWEEN l.t0 AND l.t1)
SELECT instrument, t0, t1, round(avg(1.0::DOUBLE / n), 7) AS uniqueness, CAST(count(*) / count(DISTINCT ts) AS BIGINT) AS n_labels FROM i GROUP BY 1, 2, 3""")
def label_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """The bars' times may come more than once, so they are neither made unique nor written first."""
    p = table(spark, folder, "bars").where("date_time is not null and close > 0").select("instrument", F.unix_micros("date_time").alias("ts"))
    l = W.closed_labels(labels(spark, folder), p, KEYS).where("t1 is not null and t1 >= t0")
    return W.label_uniqueness(p, l, KEYS).withColumn("uniqueness", F.round("uniqueness", 7))


_Z95 = 1.6448536269514722


@query("track_record_length", f"WITH {_RET}, {_MOMENTS} SELECT instrument, n, round(1 + (1 + 0.5 * sr * sr - skew * sr + (kurt - 3) / 4 * sr * sr) * pow({_Z95} / sr, 2), 2) AS least FROM y WHERE abs(sr) > 1e-3")
def track_record_length(spark: SparkSession, folder: str) -> DataFrame:
    out = B.sharpe_statistics(_returns(spark, folder), KEYS).where("n >= 10 and abs(sr) > 1e-3")
    return out.select("instrument", "n", F.round("min_track_length", 2).alias("least"))


@query("implied_frequency", f"""WITH {_RET}, g AS (SELECT instrument, avg(CASE WHEN ret > 0 THEN ret END) AS up, avg(CASE WHEN ret <= 0 THEN ret END) AS down, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p FROM x GROUP BY 1)
SELECT instrument, round(pow(up - down, 2) * p * (1 - p) / pow((up - down) * p + down, 2), 4) AS frequency FROM g WHERE abs((up - down) * p + down) > 1e-4""")
def implied_frequency(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("ret")
    g = _returns(spark, folder).groupBy("instrument").agg(F.avg(F.when(r > 0, r)).alias("up"), F.avg(F.when(r <= 0, r)).alias("down"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("p"))
    g = g.where(F.abs((F.col("up") - F.col("down")) * F.col("p") + F.col("down")) > 1e-4)
    return g.select("instrument", F.round(B.implied_frequency(F.col("down"), F.col("up"), F.col("p"), F.lit(1.0)), 4).alias("frequency"))


# Entropies.

_JOINT = f"""WITH {_PAIRS}, s AS (SELECT a, b, count(*) AS n, corr(x, y) AS r, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q GROUP BY 1, 2 HAVING count(*) >= 10),
t AS (SELECT *, CAST(round_even(sqrt(1 + sqrt(1 + 24 * n / (1 - r * r))) / sqrt(2.0), 0) AS INTEGER) AS bins FROM s), c AS (SELECT q.a, q.b, n, bins, least(floor((x - x0) / (x1 - x0) * bins), bins - 1) AS i, least(floor((y - y0) / (y1 - y0) * bins), bins - 1) AS j FROM q JOIN t ON t.a = q.a AND t.b = q.b),
h AS (SELECT a, b, n, ln(n) - sum(k * ln(k)) / n AS h FROM (SELECT a, b, n, i, count(*) AS k FROM c GROUP BY ALL) GROUP BY a, b, n), g AS (SELECT a, b, ln(n) - sum(k * ln(k)) / n AS h FROM (SELECT a, b, n, j, count(*) AS k FROM c GROUP BY ALL) GROUP BY a, b, n), f AS (SELECT a, b, ln(n) - sum(k * ln(k)) / n AS h FROM (SELECT a, b, n, i, j, count(*) AS k FROM c GROUP BY ALL) GROUP BY a, b, n),
mv AS (SELECT asset, day, sign(x - lag(x) OVER (PARTITION BY asset ORDER BY day)) AS mv FROM p),
sg AS (SELECT asset, day, coalesce(last_value(CASE WHEN mv <> 0 THEN mv END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS sgn, row_number() OVER (PARTITION BY asset ORDER BY day DESC) AS back FROM mv),
w AS (SELECT asset, -sum(k / n * log2(k / n)) AS e FROM (SELECT asset, sgn, count(*) AS k, sum(count(*)) OVER (PARTITION BY asset) AS n FROM sg WHERE back > 1 GROUP BY 1, 2) GROUP BY 1)
SELECT h.a, h.b, round(wa.e + wb.e - (h.h + g.h - f.h), 5) AS joint FROM h JOIN g ON g.a = h.a AND g.b = h.b JOIN f ON f.a = h.a AND f.b = h.b JOIN w wa ON wa.asset = h.a JOIN w wb ON wb.asset = h.b"""


@query("joint_entropy", _JOINT)
def joint_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return D.joint_entropy(_panel(spark, folder), "day", "asset", "x", "plug_in").select("a", "b", F.round("joint", 5).alias("joint"))


@query("decile_message_entropy")
def decile_message_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Kontoyiannis entropy of the last ten returns, each written as the digit of its decile among the instrument's."""
    s = _days(spark, folder)
    returns = s.let(r=s.log_return("c")).rows("instrument", "day", "r").where("r is not null")
    return E.decile_entropy(returns, KEYS, "day", "r", exact_quantiles(returns, KEYS, "r", [i / 10 for i in range(1, 10)]))


# User functions.


@query("mapped_index", f"WITH {DAILY_SQL} SELECT instrument, day, c * c AS squared FROM daily")
def mapped_index(spark: SparkSession, folder: str) -> DataFrame:
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["instrument", "day"]].assign(squared=pdf.c * pdf.c)

    return mapping.map_index(daily(spark, folder), ["day", "instrument"], fn, "instrument bigint, day bigint, squared double", 8, nested=True)


@query("bar_functions", f"""WITH {SIGNS_SQL}, b AS (SELECT *, (rn - 1) // 5 AS bar FROM signs) SELECT instrument, max(rn) AS tick_num, arg_max(price, rn) - arg_min(price, rn) AS move, sum(volume * sgn) AS flow FROM b GROUP BY instrument, bar HAVING count(*) = 5""")
def bar_functions(spark: SparkSession, folder: str) -> DataFrame:
    t = ticks(spark, folder)
    features = [R.bar_function("move", lambda c: c["price"][-1] - c["price"][0]), R.bar_function("flow", lambda c: (c["volume"] * c["sign"]).sum(), ["volume", "sign"])]
    return R.bars_with_features(t, R.tick_bars(t, threshold=5), features).select("instrument", "tick_num", "move", "flow")


# Files.


def _scratch(spark: SparkSession) -> str:
    """A folder in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/barloom/files-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


_TICK_FILE = T.StructType([T.StructField("instrument", T.LongType()), T.StructField("us", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])


@query("csv_ticks", f"WITH {TICKS_SQL} SELECT instrument, epoch_us(ts) AS us, price, volume, 0::BIGINT AS malformed FROM ticks")
def csv_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks written as CSV in two appends, and read again with the order of files and rows."""
    out, t = _scratch(spark), ticks(spark, folder).select("instrument", F.unix_micros("ts").alias("us"), "price", "volume")
    files.write_bars(t.where("instrument % 2 = 0"), f"{out}/a", "csv")
    files.write_bars(t.where("instrument % 2 <> 0"), f"{out}/a", "csv", append=True)
    rows = files.read_tick_csv(spark, [f"{out}/a"], schema=_TICK_FILE)
    return rows.select("instrument", "us", "price", "volume", F.when(F.col("_malformed").isNotNull(), 1).otherwise(0).cast("bigint").alias("malformed"))


@query("csv_bars_to_parquet", f"WITH {SIGNS_SQL} SELECT instrument, max(rn) AS tick_num, arg_max(price, rn) AS close, sum(volume) AS volume FROM signs GROUP BY instrument, (rn - 1) // 5 HAVING count(*) = 5")
def csv_bars_to_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """Bars written as CSV, gathered into one parquet table, checked and read."""
    out, bars = _scratch(spark), R.tick_bars(ticks(spark, folder), threshold=5).select("instrument", "tick_num", "close", "volume")
    files.write_bars(bars, f"{out}/csv", "csv")
    files.csv_to_parquet(spark, f"{out}/csv/*.csv", f"{out}/parquet", bars.schema)
    return files.check_ticks(spark.read.parquet(f"{out}/parquet"), (("instrument", "bigint"), ("tick_num", "bigint"), ("close", "double"), ("volume", "double")))


@query("panels_from_csv", f"WITH {DAILY_SQL} SELECT day AS ts, instrument AS security, o AS open, c AS close FROM daily")
def panels_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of dates by securities as CSV files, one for opens and one for closes, side by side as long rows."""
    out, d = _scratch(spark), materialize(daily(spark, folder).select("instrument", "day", "o", "c"), "panel")
    for name, c in (("open", "o"), ("close", "c")):
        files.write_panel(d.withColumnRenamed("day", "ts"), f"{out}/{name}", "ts", "instrument", c)
    return files.read_panels(spark, {n: f"{out}/{n}" for n in ("open", "close")}).select(F.col("ts").cast("bigint").alias("ts"), F.col("security").cast("bigint").alias("security"), "open", "close").where("open is not null and close is not null")


@query("outer_align", f"""WITH {DAILY_SQL}, a AS (SELECT instrument, day, c FROM daily WHERE day % 3 <> 0), b AS (SELECT instrument, day, v FROM daily WHERE day % 2 = 0)
SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.day, b.day) AS day, a.c, b.v FROM a FULL JOIN b ON a.instrument = b.instrument AND a.day = b.day""")
def outer_align(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder)
    return D.align_outer(d.where("day % 3 <> 0").select("instrument", "day", "c"), d.where("day % 2 = 0").select("instrument", "day", "v"), ["instrument", "day"])


@query("date_slice", f"WITH {DAILY_SQL}, m AS (SELECT min(day) AS a FROM daily) SELECT instrument, day, c FROM daily, m WHERE day BETWEEN a + 10 AND a + 40")
def date_slice(spark: SparkSession, folder: str) -> DataFrame:
    d = daily(spark, folder)
    first = d.agg(F.min("day")).first()[0] or 0
    return D.label_slice(d, "day", first + 10, first + 40).select("instrument", "day", "c")


@query("returns_of_lags", f"WITH {DAILY_SQL} SELECT instrument, day, c - {lag_sql('c', 2)} AS diff_2 FROM daily")
def returns_of_lags(spark: SparkSession, folder: str) -> DataFrame:
    s = _days(spark, folder)
    return s.let(diff_2=F.col("c") - s.lag("c", 2)).rows("instrument", "day", "diff_2")
