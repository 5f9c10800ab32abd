"""Queries of the operators for training text, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.chunking import split_documents
from barloom.llm.leakage import find_leaks, remove_leaks
from barloom.llm.mixing import Mix
from barloom.llm.quantiles import percentiles, summarize

RANGES = {"prob": (0.0, 1.0), "target_rets": (-1.0, 1.0)}

_VALUES = """
WITH v AS (
  SELECT instrument, strftime(make_timestamp(epoch_us(ts)), '%Y-%m') AS month, 'prob' AS field, prob AS x FROM train WHERE prob BETWEEN 0 AND 1
  UNION ALL SELECT instrument, strftime(make_timestamp(epoch_us(ts)), '%Y-%m'), 'target_rets', target_rets FROM train WHERE target_rets BETWEEN -1 AND 1),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument, month, field ORDER BY x) AS k, count(*) OVER (PARTITION BY instrument, month, field) AS n FROM v),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p)"""

SQL = {
    "p5_found": _VALUES + """
SELECT instrument, month, field FROM r WHERE (field = 'prob' AND k = (n + 1) // 2 AND x > 0.60) OR (field = 'target_rets' AND k = (n * 95 + 99) // 100 AND x > 0.08)""",
    "p5_percentiles": _VALUES + """
SELECT instrument, month, field, CAST(p AS DOUBLE) AS probability, x AS value, n AS total FROM r, q WHERE k = CAST(ceil(round(p * n, 6)) AS BIGINT)""",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _percentiles(spark: SparkSession, folder: str, probabilities: list[float]) -> DataFrame:
    train = _table(spark, folder, "train").withColumn("month", F.date_format(F.date_from_unix_date(F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).cast("int")), "yyyy-MM"))
    return percentiles(summarize(train, ["instrument", "month"], RANGES), ["instrument", "month"], probabilities)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    high = ((c("field") == "prob") & (c("probability") == 0.5) & (c("value") > 0.60)) | ((c("field") == "target_rets") & (c("probability") == 0.95) & (c("value") > 0.08))
    return _percentiles(spark, folder, [0.5, 0.95]).where(high).select("instrument", "month", "field")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _percentiles(spark, folder, [0.05, 0.25, 0.5, 0.75, 0.95])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return remove_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def _mix(spark: SparkSession, folder: str) -> Mix:
    return Mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report().where("short").select("source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report()


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).selection()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_documents(_table(spark, folder, "documents")).where((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_documents(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_percentiles, p7_found, p7_cleaned, p8_found, p8_shares, p8_selection, p9_found, p9_pieces)}
