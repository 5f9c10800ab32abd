"""Queries of the streaming operators: whole tables replayed as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.bars import WARM, _threshold_sql, _tidy, imbalance_sql, run_sql
from barloom.plans.features import cusum_sql, dynamic_z_sql
from barloom.plans.inputs import TICKS_SQL, ticks
from barloom.plans.registry import query
from barloom.shared import materialize, shared_folder
from barloom.streaming import bars as T

KEYS = ["instrument"]


def _replayed(spark: SparkSession, folder: str, build) -> DataFrame:
    name = f"barloom/stream-{uuid.uuid4().hex}"
    out = T.replay(materialize(ticks(spark, folder), "ticks"), build, shared_folder(spark), name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


@query("stream_volume_bars", _threshold_sql("volume", 250))
def stream_volume_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(_replayed(spark, folder, lambda s: T.stream_threshold_bars(s, KEYS, "volume", 250))).drop("late", "threshold", "cum_theta")


@query("stream_imbalance_bars", imbalance_sql("tick", WARM, ", 0::BIGINT AS late"))
def stream_imbalance_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(_replayed(spark, folder, lambda s: T.stream_imbalance_bars(s, KEYS, "tick", WARM)))


@query("stream_run_bars", run_sql("tick", WARM, ", 0::BIGINT AS late"))
def stream_run_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(_replayed(spark, folder, lambda s: T.stream_run_bars(s, KEYS, "tick", WARM)))


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_micros("_ts")).drop("_ts")


_SERIES = f"{TICKS_SQL}, s AS (SELECT instrument, epoch_us(ts) AS tm, rn, price AS x FROM ticks)"


@query("stream_cusum", f"WITH RECURSIVE {_SERIES}, {cusum_sql('s', 50.0)} SELECT instrument, tm AS ts, direction, 0::BIGINT AS late FROM walk WHERE direction <> 0")
def stream_cusum(spark: SparkSession, folder: str) -> DataFrame:
    return _micros(_replayed(spark, folder, lambda s: T.stream_cusum(s, KEYS, "price", 50.0)))


@query("stream_dynamic_z", f"WITH RECURSIVE {_SERIES}, {dynamic_z_sql('s', 10, 3.0, 0.3)} SELECT instrument, tm AS ts, signal, 0::BIGINT AS late FROM walk WHERE rn > 0")
def stream_dynamic_z(spark: SparkSession, folder: str) -> DataFrame:
    return _micros(_replayed(spark, folder, lambda s: T.stream_dynamic_z(s, KEYS, "price", 10, 3.0, 0.3)))


@query("stream_time_bars", f"""WITH {TICKS_SQL}, g AS (SELECT instrument, (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS date_time, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
  sum(volume) AS volume, count(*) AS cum_ticks, round(sum(price * volume), 4) AS cum_dollar_value FROM ticks GROUP BY 1, 2)
SELECT * FROM g WHERE date_time <= (SELECT max(epoch_us(ts)) - 60000000 FROM ticks)""")
def stream_time_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _tidy(_replayed(spark, folder, lambda s: T.stream_time_bars(s, KEYS, 86400)))
