"""One object per tick table, for interactive use: the bars of ``operators.bars`` with the usual defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.sources.ticks import check_ticks, read_tick_csv, write_bars

#: Seconds of a time unit.
RESOLUTIONS = {"D": 86_400, "H": 3_600, "MIN": 60, "S": 1}


class Ticks:
    """Ticks with ``ts``, ``seq``, ``price`` and ``volume``, in series by ``keys`` (one series if there are none)."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ()) -> None:
        check_ticks(df)
        if "seq" not in df.columns:
            raise ValueError("column seq is missing: it makes the order of equal times certain")
        self.keys = list(keys) or ["_series"]
        self.df = df if keys else df.withColumn("_series", F.lit(0))

    @classmethod
    def from_csv(cls, spark: SparkSession, paths: str | Sequence[str], **options) -> "Ticks":
        """Files of time, price and volume; rows that don't parse are left out (``sources.ticks.read_tick_csv`` keeps them)."""
        rows = read_tick_csv(spark, [paths] if isinstance(paths, str) else list(paths), **options)
        return cls(rows.where("_malformed is null and ts is not null and price is not null").drop("_malformed"))

    def _out(self, bars: DataFrame, path: str | None, kind: str) -> DataFrame:
        bars = bars.drop("_series")
        if path:
            write_bars(bars, path, kind)
        return bars

    def tick_bars(self, threshold: int = 600, path: str | None = None, kind: str = "csv") -> DataFrame:
        return self._out(B.tick_bars(self.df, self.keys, threshold), path, kind)

    def volume_bars(self, threshold: float = 10_000, path: str | None = None, kind: str = "csv") -> DataFrame:
        return self._out(B.volume_bars(self.df, self.keys, threshold), path, kind)

    def dollar_bars(self, threshold: float = 1_000_000, path: str | None = None, kind: str = "csv") -> DataFrame:
        return self._out(B.dollar_bars(self.df, self.keys, threshold), path, kind)

    def time_bars(self, resolution: str = "D", units: int = 1, path: str | None = None, kind: str = "csv") -> DataFrame:
        if resolution not in RESOLUTIONS:
            raise ValueError(f"resolution is one of {list(RESOLUTIONS)}")
        return self._out(B.time_bars(self.df, self.keys, RESOLUTIONS[resolution] * units), path, kind)

    def imbalance_bars(self, metric: str, expectation: B.Expectation = B.Expectation(), thresholds: bool = False, path: str | None = None, kind: str = "csv") -> DataFrame:
        """With ``thresholds`` also what each bar broke, and by what."""
        return self._out(B.imbalance_bars(self.df, metric, self.keys, expectation, thresholds), path, kind)

    def run_bars(self, metric: str, expectation: B.Expectation = B.Expectation(), thresholds: bool = False, path: str | None = None, kind: str = "csv") -> DataFrame:
        return self._out(B.run_bars(self.df, metric, self.keys, expectation, thresholds), path, kind)

    def bars_with_features(self, bars: DataFrame, features: Sequence[B.BarFeature]) -> DataFrame:
        named = bars if self.keys != ["_series"] else bars.withColumn("_series", F.lit(0))
        return B.bars_with_features(self.df, named, features, self.keys).drop("_series")
