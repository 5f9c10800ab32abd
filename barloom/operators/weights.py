"""Sample weights: concurrency, uniqueness, return attribution, time decay, sequential bootstrap. Times are epoch microseconds; labels have
t0 and t1 per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.joins import interval_sums, range_join, sweep, range_join
from barloom.ordering import HOUR_US, cell_keys, earlier_cells, running, with_cells


def closed_labels(labels: DataFrame, prices: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """labels with a null t1 set to the last price time."""
    last = prices.groupBy(*keys).agg(F.max(ts).alias("_last"))
    return labels.join(last, list(keys), "left").withColumn("t1", F.coalesce("t1", "_last")).drop("_last")


def concurrency(prices: DataFrame, labels: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """prices with ``n_labels``: how many labels hold the time (both ends included)."""
    out = sweep(prices, labels, keys, ts, "t0", "t1", {"n_labels": F.lit(1)})
    return out.withColumn("n_labels", F.col("n_labels").cast("bigint"))


def average_uniqueness(prices: DataFrame, labels: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """keys, t0, t1 and ``uniqueness``: the mean of 1 / concurrency over the label's price times; null where it holds none."""
    c = concurrency(prices, labels, keys, ts).where(F.col("n_labels") > 0)
    sums = interval_sums(c, labels, keys, ts, "t0", "t1", {"_u": 1 / F.col("n_labels"), "_n": F.lit(1.0)})
    return sums.select(*keys, "t0", "t1", F.try_divide("_u", F.round("_n")).alias("uniqueness"))


def log_returns(prices: DataFrame, keys: Sequence[str], ts: str = "ts", close: str = "close") -> DataFrame:
    """prices with ``ret``, the log return since the price before."""
    return running(prices, keys, ts, [], {"_before": ("last", close)}, inclusive=False).withColumn("ret", F.ln(F.try_divide(F.col(close), F.col("_before")))).drop("_before")


def weights_by_return(prices: DataFrame, labels: DataFrame, keys: Sequence[str], ts: str = "ts", close: str = "close") -> DataFrame:
    """keys, t0, t1 and ``weight``: |sum of return / concurrency| over the label, scaled to a mean of 1 in each series."""
    c = concurrency(log_returns(prices, keys, ts, close), labels, keys, ts).where(F.col("n_labels") > 0)
    sums = interval_sums(c, labels, keys, ts, "t0", "t1", {"_w": F.col("ret") / F.col("n_labels")})
    w = sums.withColumn("_w", F.abs("_w"))
    total = w.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.count(F.lit(1)).alias("_n"))
    return w.join(total, list(keys)).select(*keys, "t0", "t1", F.try_divide(F.col("_w") * F.col("_n"), F.col("_all")).alias("weight"))


def weights_by_time_decay(uniqueness: DataFrame, keys: Sequence[str], decay: float = 1.0) -> DataFrame:
    """keys, t0 and ``weight``: linear in the cumulated uniqueness, 1 for the newest label; decay is the oldest one's weight, or if negative the
    share of oldest labels that get 0."""
    rows = running(uniqueness.where(F.col("uniqueness").isNotNull()), keys, "t0", ["t1"], {"_c": ("sum", "uniqueness")})
    total = rows.groupBy(*keys).agg(F.sum("uniqueness").alias("_all"))
    slope = F.try_divide(F.lit(1.0 - decay), F.col("_all")) if decay >= 0 else F.try_divide(F.lit(1.0), (decay + 1) * F.col("_all"))
    w = 1 - slope * F.col("_all") + slope * F.col("_c")
    return rows.join(total, list(keys)).select(*keys, "t0", F.greatest(w, F.lit(0.0)).alias("weight"))


def indicator_rows(points: DataFrame, labels: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The indicator matrix of bars by labels, as the rows (keys, ts, t0, t1) of its ones: bars are the times of ``points`` and of the labels' ends within the span
    of the labels. The matrix is sparse, but has a row for each bar of each label."""
    spans = labels.groupBy(*keys).agg(F.min("t0").alias("_a"), F.max("t1").alias("_z"))
    ends = labels.select(*keys, F.explode(F.array("t0", "t1")).alias(ts))
    bars = points.select(*keys, ts).unionByName(ends).distinct().join(spans, list(keys)).where(F.col(ts).between(F.col("_a"), F.col("_z"))).select(*keys, ts)
    return range_join(bars, labels.select(*keys, "t0", "t1"), keys, ts, "t0", "t1").select(*keys, ts, "t0", "t1")


def label_uniqueness(points: DataFrame, labels: DataFrame, keys: Sequence[str], ts: str = "ts", cell_us: int = 6 * HOUR_US) -> DataFrame:
    """keys, t0, t1 and ``uniqueness``: the mean over a label's bars, those of ``indicator_rows``, of 1 / labels at the bar; equal labels are one row with ``n_labels``.
    A label is the difference of running sums at its two ends and meets no other bar. The sums are whole numbers of 2**-60, in two parts, so differences are exact."""
    known = labels.where(F.col("t1") >= F.col("t0")).where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys, "t0", "t1").agg(F.count(F.lit(1)).alias("n_labels"))
    none = F.lit(0).cast("bigint")
    ends = F.explode(F.array(F.struct(F.col("t0").alias("t"), F.col("n_labels").alias("o"), none.alias("c")), F.struct(F.col("t1").alias("t"), none.alias("o"), F.col("n_labels").alias("c")))).alias("_e")
    events = known.select(*keys, ends).select(*keys, F.col("_e.t").alias("_t"), F.col("_e.o").alias("_opened"), F.col("_e.c").alias("_closed"))
    events = events.unionByName(points.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t"), none.alias("_opened"), none.alias("_closed")))
    columns, by = cell_keys(events, keys, "_t", cell_us)
    bars = events.select("_t", "_opened", "_closed", *[c.alias(n) for n, c in columns.items()]).repartition(*by).groupBy(*by, "_t").agg(F.sum("_opened").alias("_opened"), F.sum("_closed").alias("_closed"))
    here = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)

    def carried(rows: DataFrame, sums: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]).select(*by, *[F.coalesce(F.sum(c).over(earlier_cells(by)), none).alias(f"_before{c}") for c in sums])

    net = bars.withColumn("_net", F.col("_opened") - F.col("_closed"))
    held = with_cells(net.withColumn("_run", F.sum("_net").over(here)), carried(net, ["_net"]), by)
    held = held.select(*[F.col(f"l.{c}") for c in [*by, "_t", "_opened"]], F.col("l._closed"), (F.col("l._run") + F.col("r._before_net") + F.col("l._closed")).alias("_n")).where("_n > 0")
    parts = ["_high", "_low", "_bars"]
    share = held.withColumn("_u", F.expr(f"({1 << 60} + _n div 2) div _n"))
    share = share.select(*by, "_t", (F.col("_opened") + F.col("_closed") > 0).alias("_is_end"), F.shiftright("_u", 30).alias("_high"), F.col("_u").bitwiseAND((1 << 30) - 1).alias("_low"), F.lit(1).cast("bigint").alias("_bars"))
    runs = with_cells(share.withColumns({f"_run{c}": F.sum(c).over(here) for c in parts}).where("_is_end"), carried(share, parts), by)
    runs = runs.select(*[F.col(f"l.{c}") for c in [*by, "_t", *parts]], *[(F.col(f"l._run{c}") + F.col(f"r._before{c}")).alias(f"_run{c}") for c in parts])

    ends = F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(False).alias("last")), F.struct(F.col("t1").alias("t"), F.lit(True).alias("last")))).alias("_e")
    wanted = known.select(*keys, "t0", "t1", "n_labels", ends).select(*keys, "t0", "t1", "n_labels", F.col("_e.t").alias("_t"), F.col("_e.last").alias("_last"))
    wanted = wanted.withColumns(cell_keys(wanted, keys, "_t", cell_us)[0])
    met = wanted.alias("l").join(runs.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_t"]])
    signed = [F.sum(F.when(F.col("l._last"), F.col(f"r._run{c}")).otherwise(F.col(f"r.{c}") - F.col(f"r._run{c}"))).alias(c) for c in parts]
    out = met.groupBy(*[F.col(f"l.{c}") for c in [*keys, "t0", "t1"]]).agg(*signed, F.max("l.n_labels").alias("n_labels"))
    total = F.col("_high") / F.lit(float(1 << 30)) + F.col("_low") / F.lit(float(1 << 60))
    return out.select(*keys, "t0", "t1", (total / F.col("_bars")).alias("uniqueness"), "n_labels")


class Bootstrap:
    """Sequential bootstrap over label intervals: each draw is made in proportion to the average uniqueness that a label would have among
    those drawn. Labels are ranges of places on the common time axis, so state is one count per place and prefix sums."""

    def __init__(self, t0: np.ndarray, t1: np.ndarray, times: np.ndarray | None = None) -> None:
        axis = np.unique(np.concatenate([t0, t1, times if times is not None else t0]))
        self.first, self.last, self.size = np.searchsorted(axis, t0), np.searchsorted(axis, t1), len(axis)

    def matrix(self) -> np.ndarray:
        m = np.zeros((self.size, len(self.first)))
        for j, (a, b) in enumerate(zip(self.first, self.last)):
            m[a : b + 1, j] = 1
        return m

    def average_uniqueness(self, drawn: Sequence[int] | None = None) -> float:
        """Mean over all (label, place) of 1 / labels at the place."""
        idx = np.arange(len(self.first)) if drawn is None else np.asarray(drawn)
        count = self._count(idx)
        lengths = self.last[idx] - self.first[idx] + 1
        prefix = np.concatenate([[0.0], np.cumsum(np.divide(1.0, count, out=np.zeros(self.size), where=count > 0))])
        return float((prefix[self.last[idx] + 1] - prefix[self.first[idx]]).sum() / lengths.sum())

    def label_uniqueness(self) -> np.ndarray:
        """The indicator matrix over the labels at each place: labels in rows."""
        m = self.matrix()
        c = m.sum(axis=1)
        return np.divide(m.T, c, out=np.zeros_like(m.T), where=c > 0)

    def _count(self, idx: np.ndarray) -> np.ndarray:
        step = np.zeros(self.size + 1)
        np.add.at(step, self.first[idx], 1)
        np.add.at(step, self.last[idx] + 1, -1)
        return np.cumsum(step)[:-1]

    def probabilities(self, count: np.ndarray) -> np.ndarray:
        prefix = np.concatenate([[0.0], np.cumsum(1 / (1 + count))])
        u = (prefix[self.last + 1] - prefix[self.first]) / (self.last - self.first + 1)
        return u / u.sum()

    def draw(self, n: int | None = None, seed: int = 0, warmup: Sequence[int] = ()) -> list[int]:
        rng, count, out = np.random.default_rng(seed), np.zeros(self.size), []
        warm = list(warmup)
        while len(out) < (n if n is not None else len(self.first)):
            pick = warm.pop(0) if warm else int(rng.choice(len(self.first), p=self.probabilities(count)))
            count[self.first[pick] : self.last[pick] + 1] += 1
            out.append(pick)
        return out

    def draw_local(self, n: int | None = None, seed: int = 0, width: int = 512) -> list[int]:
        """``draw`` without a pass over all labels for each draw: a draw changes the weights of the labels that meet it, and sums of
        ``width`` weights each find the next. Labels must be sorted by start."""
        first, last, size = self.first, self.last, len(self.first)
        latest = np.maximum.accumulate(last)
        low, high = np.searchsorted(latest, first), np.searchsorted(first, last, side="right")
        rng, count, out = np.random.default_rng(seed), np.zeros(self.size), []
        u = np.zeros(-(-size // width) * width)
        u[:size] = 1.0
        blocks = u.reshape(-1, width)
        sums = blocks.sum(axis=1)
        for _ in range(n if n is not None else size):
            ends = np.cumsum(sums)
            at = rng.random() * ends[-1]
            k = min(int(np.searchsorted(ends, at, side="right")), len(ends) - 1)
            inner = np.cumsum(blocks[k])
            pick = min(k * width + int(np.searchsorted(inner, at - (ends[k - 1] if k else 0.0), side="right")), size - 1)
            out.append(pick)
            count[first[pick] : last[pick] + 1] += 1
            a, b = low[pick], high[pick]
            start = first[a]
            prefix = np.concatenate([[0.0], np.cumsum(1 / (1 + count[start : latest[b - 1] + 1]))])
            u[a:b] = (prefix[last[a:b] + 1 - start] - prefix[first[a:b] - start]) / (last[a:b] - first[a:b] + 1)
            sums[a // width : (b - 1) // width + 1] = blocks[a // width : (b - 1) // width + 1].sum(axis=1)
        return out


def sequential_bootstrap(labels: DataFrame, keys: Sequence[str], n: int, samples: int = 1, seed: int = 0) -> DataFrame:
    """keys, ``sample``, ``draw``, t0 and t1 of ``n`` labels per series and sample. Each (series, sample) is one task; a draw depends on all before it,
    so a series' labels must fit a task."""
    rows = labels.where(F.col("t1") >= F.col("t0")).select(*keys, "t0", "t1", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))).alias("sample"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in labels.select(*keys).schema)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "t1"]).reset_index(drop=True)
        picks = Bootstrap(pdf.t0.to_numpy(), pdf.t1.to_numpy()).draw(n, seed + int(pdf["sample"].iloc[0]))
        out = pdf.iloc[picks].reset_index(drop=True)
        out["draw"] = np.arange(len(out))
        return out[[*keys, "sample", "draw", "t0", "t1"]]

    return rows.groupBy(*keys, "sample").applyInPandas(draw, f"{kept}, sample bigint, draw bigint, t0 bigint, t1 bigint")
