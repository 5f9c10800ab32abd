"""Queries of the general data-cleaning operators: grid, periods, trailing totals, spikes, text records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.grid import regular_grid
from barloom.operators.periods import interval_gaps, merge_intervals
from barloom.operators.spikes import ROBUST, Ellipsoid, Measure, flag_readings
from barloom.operators.trailing import trailing_totals
from barloom.plans.registry import query, table
from barloom.sources.records import loaded, parse_records, rejected

CALENDAR_SQL = """
WITH latest AS (
  SELECT instrument, d AS day, "Close" AS c, "Volume" AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument, d ORDER BY seq DESC) AS rn
    FROM (SELECT *, DATE '1970-01-01' + CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS d FROM ohlcv_daily WHERE ts IS NOT NULL)) WHERE rn = 1
), span AS (SELECT instrument, min(day) AS a, max(day) AS b FROM latest GROUP BY 1),
dense AS (SELECT instrument, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, a FROM span),
filled AS (
  SELECT d.instrument, d.day, d.a, CAST(round(l.c * 100) AS BIGINT) AS c, CAST(l.v AS BIGINT) AS v, l.day IS NOT NULL AS active
  FROM dense d LEFT JOIN latest l ON l.instrument = d.instrument AND l.day = d.day
), t AS (
  SELECT instrument, day, active, CAST(date_diff('day', a, day) + 1 AS INTEGER) AS history_days,
    coalesce(sum(v) OVER w7, 0) AS v7, coalesce(sum(v) OVER w30, 0) AS v30, count(v) OVER w7 AS nv7, count(v) OVER w30 AS nv30,
    coalesce(sum(c) OVER w7, 0) AS c7, coalesce(sum(c) OVER w30, 0) AS c30, count(c) OVER w7 AS n7, count(c) OVER w30 AS n30
  FROM filled
  WINDOW w7 AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)"""


@query("p1_found", """
WITH b AS (SELECT DISTINCT instrument, CAST(floor(epoch_us(date_time) / 1800000000.0) AS BIGINT) AS s FROM bars WHERE date_time IS NOT NULL AND close IS NOT NULL),
r AS (SELECT instrument, s // 48 AS d, min(s) AS a, max(s) AS z FROM b GROUP BY 1, 2),
g AS (SELECT instrument, unnest(range(a, z + 1)) AS s FROM r)
SELECT g.instrument, g.s * 1800 AS slot_start FROM g ANTI JOIN b ON g.instrument = b.instrument AND g.s = b.s""")  # fmt: skip
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    grid = regular_grid(table(spark, folder, "bars"))
    return grid.where((F.col("close_source") == "modelled") & F.col("close_filled").isNotNull()).select("instrument", "slot_start")


def _fit_sql(v: str, harmonics: int = 2) -> str:
    """Table fit_<v>: instrument and b0 .. bp of the regression, solved by elimination."""
    waves = [f"{f}({k} * ph)" for k in range(1, harmonics + 1) for f in ("cos", "sin")]
    p = range(1, 2 + 2 * harmonics)
    x = [f"s / 48.0::DOUBLE AS x1, {', '.join(f'{w} AS x{i}' for i, w in enumerate(waves, 2))}"]
    sums = [f"avg(x{i}) AS m{i}" for i in p] + [f"sum(x{i} * x{j}) AS q{i}{j}" for i in p for j in p if j >= i] + [f"sum(x{i} * y) AS t{i}" for i in p]
    centred = [f"q{i}{j} - n * m{i} * m{j} AS c{i}{j}" for i in p for j in p if j >= i] + [f"t{i} - n * m{i} * my AS r{i}" for i in p]
    ridge = f"1e-9::DOUBLE * abs({' + '.join(f'c{i}{i}' for i in p)}) + 1e-6::DOUBLE"
    out = [f"""d_{v} AS (SELECT instrument, {v} AS y, {', '.join(x)} FROM (SELECT *, 2 * pi() * (s % 48) / 48 AS ph FROM obs) WHERE {v} IS NOT NULL AND NOT isnan({v}) AND NOT isinf({v}))""",
        f"""u_{v} AS (SELECT instrument, count(*)::DOUBLE AS n, avg(y) AS my, {', '.join(sums)} FROM d_{v} GROUP BY 1)""", f"""z_{v} AS (SELECT *, {', '.join(centred)} FROM u_{v})""",
        f"""e0_{v} AS (SELECT * REPLACE ({', '.join(f'c{i}{i} + {ridge} AS c{i}{i}' for i in p)}) FROM z_{v})"""]
    for k in p:
        rest = [i for i in p if i > k]
        step = [f"c{i}{j} - c{k}{i} * c{k}{j} / c{k}{k} AS c{i}{j}" for i in rest for j in rest if j >= i] + [f"r{i} - c{k}{i} * r{k} / c{k}{k} AS r{i}" for i in rest]
        out.append(f"e{k}_{v} AS (SELECT *{f' REPLACE ({', '.join(step)})' if step else ''} FROM e{k - 1}_{v})")
    last = f"e{p[-1]}_{v}"
    for k in reversed(p):
        out.append(f"g{k}_{v} AS (SELECT *, (r{k}{''.join(f' - c{k}{j} * b{j}' for j in p if j > k)}) / c{k}{k} AS b{k} FROM {last})")
        last = f"g{k}_{v}"
    out.append(f"fit_{v} AS MATERIALIZED (SELECT instrument, my{''.join(f' - b{i} * m{i}' for i in p)} AS b0, {', '.join(f'b{i}' for i in p)} FROM {last})")
    return ", ".join(out)


def _grid_sql() -> str:
    waves = "coalesce(b0 + b1 * ({s}) / 48 + b2 * cos(2 * pi() * (({s}) % 48) / 48) + b3 * sin(2 * pi() * (({s}) % 48) / 48) + b4 * cos(4 * pi() * (({s}) % 48) / 48) + b5 * sin(4 * pi() * (({s}) % 48) / 48), 0)"
    parts, columns = [], []
    for v in ("close", "volume"):
        rest = lambda e: f"CASE WHEN isnan({e}v - {waves.format(s=e + 's')}) OR isinf({e}v - {waves.format(s=e + 's')}) THEN 0 ELSE {e}v - {waves.format(s=e + 's')} END"  # noqa: B023, E731
        parts.append(f"""k_{v} AS (SELECT g.instrument, g.s, o.{v}, last_value(CASE WHEN {v} IS NOT NULL THEN g.s END IGNORE NULLS) OVER w AS ps, last_value({v} IGNORE NULLS) OVER w AS pv,
  first_value(CASE WHEN {v} IS NOT NULL THEN g.s END IGNORE NULLS) OVER f AS qs, first_value({v} IGNORE NULLS) OVER f AS qv FROM g LEFT JOIN obs o USING (instrument, s)
  WINDOW w AS (PARTITION BY instrument, s // 48 ORDER BY s ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY instrument, s // 48 ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
h_{v} AS (SELECT instrument, s, {v}, CASE WHEN {v} IS NOT NULL THEN {v} WHEN ps IS NOT NULL AND qs IS NOT NULL THEN {waves.format(s='s')} + ({rest('p')}) * (1 - (s - ps) / (qs - ps)::DOUBLE) + ({rest('q')}) * ((s - ps) / (qs - ps)::DOUBLE) END AS filled,
  CASE WHEN {v} IS NOT NULL THEN 'observed' WHEN ps IS NOT NULL AND qs IS NOT NULL THEN 'modelled' ELSE 'open' END AS source FROM k_{v} LEFT JOIN fit_{v} USING (instrument))""")
        filled = f"h_{v}.filled" if v == "close" else f"CASE WHEN h_{v}.source = 'modelled' THEN greatest(h_{v}.filled, 0) ELSE h_{v}.filled END"
        digits = 3 if v == "close" else 1
        columns.append(f"round(h_{v}.{v}, {digits}) AS {v}, round({filled}, {digits}) AS {v}_filled, h_{v}.source AS {v}_source")
    return f"""WITH obs AS MATERIALIZED (SELECT instrument, epoch_us(date_time) // 1800000000 AS s, arg_max(close, (date_time, seq)) FILTER (WHERE close IS NOT NULL) AS close, sum(volume) AS volume FROM bars WHERE date_time IS NOT NULL GROUP BY 1, 2),
r AS (SELECT instrument, min(s) AS a, max(s) AS z FROM obs GROUP BY instrument, s // 48), g AS (SELECT instrument, unnest(range(a, z + 1)) AS s FROM r), {_fit_sql('close')}, {_fit_sql('volume')}, {', '.join(parts)}
SELECT h_close.instrument, h_close.s * 1800 AS slot_start, {', '.join(columns)} FROM h_close JOIN h_volume USING (instrument, s)"""


@query("p1_grid", _grid_sql())
def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = regular_grid(table(spark, folder, "bars"))
    return grid.withColumns({c: F.round(c, 3 if c.startswith("close") else 1) for c in ("close", "close_filled", "volume", "volume_filled")})


@query("p2_found", """
WITH i AS (SELECT instrument, epoch_us(t0) AS s, epoch_us(t1) AS e FROM triple_barrier_events WHERE t1 >= t0),
m AS (SELECT *, max(e) OVER (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i)
SELECT instrument, p AS gap_start, s AS gap_end FROM m WHERE s > p AND s - p <= 30 * 86400000000""")  # fmt: skip
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    gaps = interval_gaps(merge_intervals(table(spark, folder, "triple_barrier_events")), max_days=30)
    return gaps.select("instrument", F.unix_micros("gap_start").alias("gap_start"), F.unix_micros("gap_end").alias("gap_end"))


@query("p2_periods", """
WITH i AS (SELECT instrument, epoch_us(t0) AS s, epoch_us(t1) AS e FROM triple_barrier_events WHERE t1 >= t0),
m AS (SELECT *, max(e) OVER (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
l AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS k FROM m)
SELECT instrument, CAST(k AS BIGINT) AS period, min(s) AS period_start, max(e) AS period_end, count(*) AS n_intervals FROM l GROUP BY 1, 2""")  # fmt: skip
def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    periods = merge_intervals(table(spark, folder, "triple_barrier_events"))
    return periods.select("instrument", "period", F.unix_micros("period_start").alias("period_start"), F.unix_micros("period_end").alias("period_end"), "n_intervals")


def _trailing(spark: SparkSession, folder: str) -> DataFrame:
    return trailing_totals(table(spark, folder, "ohlcv_daily"), scale={"Close": 100, "Volume": 1})


@query("p3_found", CALENDAR_SQL + """
SELECT instrument, strftime(day, '%Y-%m-%d') AS day, 'volume' AS measure FROM t WHERE history_days >= 30 AND 2 * v7 > v30
UNION ALL
SELECT instrument, strftime(day, '%Y-%m-%d'), 'close' FROM t WHERE history_days >= 30 AND n7 > 0 AND 10 * c7 * n30 > 11 * c30 * n7""")  # fmt: skip
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    t = _trailing(spark, folder).where(F.col("history_days") >= 30)
    cents = lambda n: F.round(F.col(f"Close_sum_{n}") * 100, 0).cast("decimal(38,0)")
    rises = (F.col("Close_count_7") > 0) & (F.lit(10) * cents(7) * F.col("Close_count_30") > F.lit(11) * cents(30) * F.col("Close_count_7"))
    measures = F.array_compact(F.array(F.when(2 * F.col("Volume_sum_7") > F.col("Volume_sum_30"), F.lit("volume")), F.when(rises, F.lit("close"))))
    return t.select("instrument", F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(measures).alias("measure"))


@query("p3_trailing", CALENDAR_SQL + """
SELECT instrument, strftime(day, '%Y-%m-%d') AS day, active, history_days, CAST(v7 AS DOUBLE) AS volume_7, CAST(v30 AS DOUBLE) AS volume_30,
  round(c7 / 100.0 / nullif(n7, 0), 6) AS close_avg_7, round(c30 / 100.0 / nullif(n30, 0), 6) AS close_avg_30 FROM t""")  # fmt: skip
def p3_trailing(spark: SparkSession, folder: str) -> DataFrame:
    return _trailing(spark, folder).select(
        "instrument", F.date_format("day", "yyyy-MM-dd").alias("day"), "active", "history_days",
        F.col("Volume_sum_7").alias("volume_7"), F.col("Volume_sum_30").alias("volume_30"),
        F.round("Close_avg_7", 6).alias("close_avg_7"), F.round("Close_avg_30", 6).alias("close_avg_30"),
    )


CLOSE, VOLUME, DOLLARS = Measure("close", neighbours=10, stuck=8), Measure("volume", neighbours=None, stuck=8), Measure("cum_dollar_value", neighbours=None, stuck=8)


#: Bounds that a bar must keep; the expressions are SQL for Spark and DuckDB alike.
_BOUNDS = {
    "close not positive": "close <= 0",
    "volume negative": "volume < 0",
    "dollar value negative": "cum_dollar_value < 0",
    "close outside high and low": "(close > high OR close < low)",
    "dollar value below low x volume": "cum_dollar_value < CAST(0.9 AS DOUBLE) * low * volume",
    "dollar value above high x volume": "cum_dollar_value > CAST(1.1 AS DOUBLE) * high * volume",
}


def _bar_faults(spark: SparkSession, folder: str, measures: Sequence[Measure]) -> DataFrame:
    return flag_readings(table(spark, folder, "bars"), measures, bounds={name: F.expr(c) for name, c in _BOUNDS.items()})


@query("p4_found", """
WITH b AS (SELECT * FROM bars WHERE date_time IS NOT NULL),
c AS (SELECT instrument, seq, close, date_time,
    CASE WHEN count(*) OVER p = 10 THEN median(close) OVER p END AS mb, CASE WHEN count(*) OVER f = 10 THEN median(close) OVER f END AS ma,
    row_number() OVER (PARTITION BY instrument ORDER BY date_time, seq) - row_number() OVER (PARTITION BY instrument, close ORDER BY date_time, seq) AS g
  FROM b WHERE close IS NOT NULL
  WINDOW p AS (PARTITION BY instrument ORDER BY date_time, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY instrument ORDER BY date_time, seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
v AS (SELECT instrument, seq, volume, median(volume) OVER (PARTITION BY instrument) AS m,
    row_number() OVER (PARTITION BY instrument ORDER BY date_time, seq) - row_number() OVER (PARTITION BY instrument, volume ORDER BY date_time, seq) AS g
  FROM b WHERE volume IS NOT NULL)
SELECT instrument, seq FROM b WHERE close <= 0 OR volume < 0 OR cum_dollar_value < 0 OR close > high OR close < low
  OR cum_dollar_value < 0.9 * low * volume OR cum_dollar_value > 1.1 * high * volume
UNION SELECT instrument, seq FROM c WHERE abs(close - mb) > 0.1 * abs(mb) AND abs(close - ma) > 0.1 * abs(ma)
UNION SELECT instrument, seq FROM v WHERE volume > 20 * m
UNION SELECT instrument, seq FROM (SELECT instrument, seq, count(*) OVER (PARTITION BY instrument, close, g) AS n FROM c) WHERE n >= 8
UNION SELECT instrument, seq FROM (SELECT instrument, seq, count(*) OVER (PARTITION BY instrument, volume, g) AS n FROM v) WHERE n >= 8""")  # fmt: skip
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    off = lambda m: F.abs(c("reading") - c(m)) > 0.1 * F.abs(c(m))
    spike = F.when(c("measure") == "close", off("usual_before") & off("usual_after")).otherwise(c("reading") > 20 * c("usual_before"))
    faults = _bar_faults(spark, folder, [CLOSE, VOLUME])
    return faults.where((c("fault") != "spike") | spike).select("instrument", "seq").distinct()


#: Rounds that the SQL writes out; a round in which nothing new is flagged changes nothing.
_SQL_ROUNDS = 12


def _flags_sql() -> str:
    e, out = Ellipsoid(), []
    dev = lambda c: f"greatest({ROBUST} * median(abs({c})) FILTER (WHERE abs({c}) < 'inf'::DOUBLE), {e.floor})"
    scale = lambda c: f"coalesce({dev(c)}, {e.floor})"
    half = "sqrt(0.5)"
    for i in range(_SQL_ROUNDS):
        out.append(f"""s{i} AS MATERIALIZED (SELECT instrument, measure, count(*) AS n, {scale('v')} AS sv, {scale('d1')} AS s1, {scale('d2')} AS s2 FROM l{i} GROUP BY 1, 2),
a{i} AS MATERIALIZED (SELECT l.*, n, v / sv AS a, d1 / s1 AS b, d2 / s2 AS c FROM l{i} l JOIN s{i} USING (instrument, measure)),
t{i} AS MATERIALIZED (SELECT instrument, measure, {scale(f'(a + c) * {half}')} AS sp, {scale(f'(a - c) * {half}')} AS sq FROM a{i} GROUP BY 1, 2),
j{i} AS MATERIALIZED (SELECT *, coalesce(abs(a) > {e.protect} AND (isinf(a) OR coalesce(pow(coalesce((a + c) * {half}, a * {half}) / sp, 2), 0)
  + coalesce(pow(coalesce((a - c) * {half}, a * {half}) / sq, 2), 0) + coalesce(b * b, 0) > 2 * ln(greatest(n, 2))), false) AS hit FROM a{i} JOIN t{i} USING (instrument, measure)),
l{i + 1} AS MATERIALIZED (SELECT instrument, seq, measure, x, mb, ma, v, d1, d2 FROM j{i} WHERE NOT hit)""")
    bounds = "UNION ALL ".join(f"SELECT instrument, seq, NULL, 'bounds', NULL, NULL, NULL, '{name}' FROM bars WHERE date_time IS NOT NULL AND {sql} " for name, sql in _BOUNDS.items())
    return f"""WITH r AS (UNPIVOT (SELECT instrument, seq, date_time, close, volume, cum_dollar_value FROM bars WHERE date_time IS NOT NULL) ON close, volume, cum_dollar_value INTO NAME measure VALUE x),
o AS (SELECT *, row_number() OVER w AS k, CASE WHEN x > 0 THEN ln(x) END AS l, median(x) OVER (PARTITION BY instrument, measure) AS m,
  CASE WHEN count(*) OVER p = 10 THEN median(x) OVER p END AS pb, CASE WHEN count(*) OVER f = 10 THEN median(x) OVER f END AS pa,
  row_number() OVER w - row_number() OVER (PARTITION BY instrument, measure, x ORDER BY date_time, seq) AS g FROM r
  WINDOW w AS (PARTITION BY instrument, measure ORDER BY date_time, seq), p AS (PARTITION BY instrument, measure ORDER BY date_time, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY instrument, measure ORDER BY date_time, seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
q AS (SELECT *, CASE WHEN measure = 'close' THEN pb ELSE m END AS mb, CASE WHEN measure = 'close' THEN pa ELSE m END AS ma, l - lag(l) OVER w AS d1, lead(l) OVER w - 2 * l + lag(l) OVER w AS d2,
  count(*) OVER (PARTITION BY instrument, measure, x, g) AS run FROM o WINDOW w AS (PARTITION BY instrument, measure ORDER BY k)),
z AS (SELECT *, CASE WHEN mb <> 0 THEN (x - mb) / abs(mb) WHEN x = 0 AND mb = 0 THEN 0 WHEN mb = 0 THEN sign(x) * 'inf'::DOUBLE END AS ob,
  CASE WHEN ma <> 0 THEN (x - ma) / abs(ma) WHEN x = 0 AND ma = 0 THEN 0 WHEN ma = 0 THEN sign(x) * 'inf'::DOUBLE END AS oa FROM q),
l0 AS MATERIALIZED (SELECT instrument, seq, measure, x, mb, ma, CASE WHEN measure <> 'close' THEN CASE WHEN x = m THEN 0 WHEN x > 0 AND m > 0 THEN ln(x / m) WHEN x > 0 THEN 'inf'::DOUBLE END
  WHEN ob IS NULL THEN oa WHEN oa IS NULL OR abs(ob) <= abs(oa) THEN ob ELSE oa END AS v, d1, d2 FROM z),
{", ".join(out)}
SELECT instrument, seq, measure, 'spike' AS fault, x AS reading, mb AS usual_before, ma AS usual_after, NULL::VARCHAR AS rule FROM ({" UNION ALL ".join(f"SELECT * FROM j{i} WHERE hit" for i in range(_SQL_ROUNDS))})
UNION ALL SELECT instrument, seq, measure, 'stuck', x, mb, ma, NULL FROM q WHERE run >= 8
UNION ALL {bounds}"""


@query("p4_flags", _flags_sql())
def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _bar_faults(spark, folder, [CLOSE, VOLUME, DOLLARS])


_F = r'("(?:[^"]|"")*"|[^",]*)'
_P6 = rf"(?s)^{_F},{_F},{_F},{_F},{_F},{_F},{_F},{_F},{_F},{_F},{_F}$"


@query("p6_found", rf"""
WITH r AS (SELECT record_id, regexp_replace(raw_line, '\r$', '') AS t FROM raw_bars),
f AS (SELECT record_id, t, regexp_matches(t, '{_P6}') AS shaped, regexp_extract(t, '{_P6}', 2) AS d0, regexp_extract(t, '{_P6}', 7) AS c0 FROM r),
u AS (SELECT *, trim(CASE WHEN d0 LIKE '"%' THEN replace(d0[2:-2], '""', '"') ELSE d0 END, ' ') AS d,
  trim(CASE WHEN c0 LIKE '"%' THEN replace(c0[2:-2], '""', '"') ELSE c0 END, ' ') AS c FROM f)
SELECT record_id FROM u WHERE NOT coalesce(shaped
  AND regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{{1,6}})?')
  AND d[1:4] <> '0000' AND try_cast(d AS TIMESTAMP) IS NOT NULL
  AND regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
  AND try_cast(ltrim(c, '+') AS DOUBLE) > 0 AND try_cast(ltrim(c, '+') AS DOUBLE) < 1e9, false)""")  # fmt: skip
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(parse_records(table(spark, folder, "raw_bars"))).select("record_id")


def _only(i: int) -> str:
    """The record's pattern with field i as its one group."""
    free = '(?:"(?:[^"]|"")*"|[^",]*)'
    return "(?s)^" + ",".join(f"({free})" if k == i else free for k in range(11)) + "$"


def _unquoted(i: int) -> str:
    x = f"regexp_extract(t, '{_only(i)}', 1)"
    return f"""CASE WHEN {x} LIKE '"%' THEN replace({x}[2:-2], '""', '"') ELSE {x} END"""


_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_MOMENT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,6})?"
_LENIENT = {2: "tick_num", 3: "open", 4: "high", 5: "low", 7: "volume", 8: "cum_buy_volume", 9: "cum_ticks", 10: "cum_dollar_value"}
_LOADED_SQL = (
    "WITH r AS (SELECT record_id, feed_file, line_no, regexp_replace(raw_line, '\\r$', '') AS t FROM raw_bars), "
    "f AS (SELECT record_id, feed_file, line_no, " + ", ".join(f"{_unquoted(i)} AS f{i}" for i in range(11)) + f" FROM r WHERE regexp_matches(t, '{_P6}')), "
    "g AS (SELECT * REPLACE (" + ", ".join(f"trim(f{i}, ' ') AS f{i}" for i in range(1, 11)) + ") FROM f) "
    "SELECT record_id, feed_file, line_no, f0 AS instrument_name, epoch_us(CAST(f1 AS TIMESTAMP)) AS date_time_us, CAST(ltrim(f6, '+') AS DOUBLE) AS close, "
    + ", ".join(f"CASE WHEN regexp_full_match(f{i}, '{_NUMBER}') THEN try_cast(ltrim(f{i}, '+') AS DOUBLE) END AS {c}" for i, c in _LENIENT.items())
    + f" FROM g WHERE regexp_full_match(f1, '{_MOMENT}') AND f1[1:4] <> '0000' AND try_cast(f1 AS TIMESTAMP) IS NOT NULL"
    + f" AND regexp_full_match(f6, '{_NUMBER}') AND try_cast(ltrim(f6, '+') AS DOUBLE) > 0 AND try_cast(ltrim(f6, '+') AS DOUBLE) < 1e9"
)


@query("p6_loaded", _LOADED_SQL)
def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    out = loaded(parse_records(table(spark, folder, "raw_bars")))
    return out.withColumn("date_time_us", F.unix_micros("date_time")).drop("date_time")
