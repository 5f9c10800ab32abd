"""The logical inputs of the time-series queries, from the test tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.registry import table

TICKS_SQL = """ticks AS (SELECT user_id AS instrument, ts, event_id AS seq, value AS price, CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS volume,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
SIGNS_SQL = TICKS_SQL + """,
moves AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY instrument ORDER BY rn)) AS mv FROM ticks),
signs AS (SELECT *, coalesce(last_value(CASE WHEN mv <> 0 THEN CAST(mv AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS sgn FROM moves)"""
DAILY_SQL = """daily AS (SELECT instrument, CAST(d AS BIGINT) AS day, "Open" AS o, "High" AS h, "Low" AS l, "Close" AS c, "Volume" AS v, row_number() OVER (PARTITION BY instrument ORDER BY d) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument, d ORDER BY seq DESC) AS k FROM (SELECT *, epoch_us(ts) // 86400000000 AS d FROM ohlcv_daily WHERE ts IS NOT NULL))
  WHERE k = 1 AND "Close" IS NOT NULL AND "Volume" IS NOT NULL AND "Open" IS NOT NULL AND "High" IS NOT NULL AND "Low" IS NOT NULL AND "Volume" > 0)"""


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """events as ticks: one series per user."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(F.col("user_id").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (k + 1).cast("double").alias("volume"))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per instrument and day of ohlcv_daily: of several the latest, without rows that lack a value or trade nothing.
    ``day`` is the day's number, ``o h l c v`` the bar."""
    day = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))
    rows = table(spark, folder, "ohlcv_daily").where(F.col("ts").isNotNull())
    rows = rows.select("instrument", day.alias("day"), F.struct("seq", F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"), F.col("Close").alias("c"), F.col("Volume").alias("v")).alias("r"))
    best = rows.groupBy("instrument", "day").agg(F.max("r").alias("r"))
    return best.select("instrument", "day", *[F.col(f"r.{x}").alias(x) for x in "ohlcv"]).where("o is not null and h is not null and l is not null and c is not null and v > 0")


PRICES_SQL = "prices AS (SELECT instrument, epoch_us(date_time) AS ts, arg_min(close, seq) AS close FROM bars WHERE date_time IS NOT NULL AND close > 0 GROUP BY 1, 2)"
LABELS_SQL = """labels AS (SELECT instrument, epoch_us(t0) AS t0, epoch_us(max(t1)) AS t1, max(trgt) AS trgt, coalesce(max(side), 1.0) AS side, max(pt) AS pt, max(sl) AS sl
  FROM triple_barrier_events WHERE trgt IS NOT NULL AND (t1 IS NULL OR t1 >= t0) GROUP BY instrument, t0)"""


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """The bars' closes: instrument, ts (epoch microseconds, unique) and close; of rows with one time the first to arrive."""
    b = table(spark, folder, "bars").where("date_time is not null and close > 0")
    return b.groupBy("instrument", F.unix_micros("date_time").alias("ts")).agg(F.min(F.struct("seq", "close"))["close"].alias("close"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label intervals with a target, one per instrument and start: t0, t1 (epoch microseconds, t1 null where no vertical barrier), trgt, side, pt, sl."""
    e = table(spark, folder, "triple_barrier_events").where("trgt is not null and t0 is not null and (t1 is null or t1 >= t0)")
    e = e.groupBy("instrument", F.unix_micros("t0").alias("t0")).agg(F.max(F.unix_micros("t1")).alias("t1"), *[F.max(c).alias(c) for c in ("trgt", "side", "pt", "sl")])
    return e.withColumn("side", F.coalesce("side", F.lit(1.0)))
