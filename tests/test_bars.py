"""Bars: hand-worked fixtures, and the machines against a plain tick-by-tick loop."""

import datetime as dt
import random

import numpy as np
import pytest

from barloom.operators import bars as B

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "instrument long, ts timestamp, seq long, price double, volume double"


def ticks(spark, prices, volumes=None, instrument=1, step=1):
    volumes = volumes or [1.0] * len(prices)
    return spark.createDataFrame([(instrument, T0 + dt.timedelta(seconds=i * step), i, float(p), float(v)) for i, (p, v) in enumerate(zip(prices, volumes))], SCHEMA)


def test_tick_rule(spark):
    df = ticks(spark, [10, 10, 11, 11, 10, 10])
    assert [r.sign for r in B.tick_signs(df, ["instrument"]).orderBy("seq").collect()] == [0, 0, 1, 1, -1, -1]
    assert [r.sign for r in B.tick_signs(df, ["instrument"], first=1).orderBy("seq").collect()] == [1, 1, 1, 1, -1, -1]


def test_tick_rule_over_cells(spark):
    """The last change lies many calendar cells back."""
    rng = random.Random(1)
    prices = [5.0] * 3 + [rng.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(300)]
    sign, want, last = 0, [], None
    for p in prices:
        sign = sign if last is None or p == last else (1 if p > last else -1)
        want.append(sign)
        last = p
    got = [r.sign for r in B.tick_signs(ticks(spark, prices, step=50_000), ["instrument"]).orderBy("seq").collect()]
    assert got == want


def test_tick_and_volume_bars(spark):
    out = B.tick_bars(ticks(spark, [10, 11, 12, 11, 13]), threshold=2).orderBy("tick_num").collect()
    assert [(r.open, r.high, r.low, r.close) for r in out] == [(10, 11, 10, 11), (12, 12, 11, 11)]
    out = B.volume_bars(ticks(spark, [1] * 5, [6, 6, 6, 6, 3]), threshold=10).collect()
    assert sorted(r.volume for r in out) == [12, 12]
    out = B.dollar_bars(ticks(spark, [2] * 5, [6, 6, 6, 6, 3]), threshold=20).orderBy("tick_num").collect()
    assert [(r.cum_dollar_value, r.cum_ticks, r.tick_num) for r in out] == [(24, 2, 2), (24, 2, 4)]


def test_time_bars(spark):
    out = B.time_bars(ticks(spark, [1, 2, 3, 4], step=40), seconds=60).orderBy("tick_num").collect()
    start = int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert [(r.date_time - start, r.tick_num, r.close, r.cum_ticks) for r in out] == [(60, 3, 2, 2), (120, 4, 3, 1)]


def plain_ewma(x, window):
    a, w, old = 2 / (window + 1), 1.0, x[0]
    for i in range(1, len(x)):
        w += (1 - a) ** i
        old = old * (1 - a) + x[i]
    return old / w if len(x) > 1 else x[0]


def plain_bars(kind, metric, e, prices, volumes):
    """Bar ends, a tick at a time."""
    ends, sign, last = [], 0, None
    T, lengths, n = float(e.ticks), [], 0
    imb, exp, theta = [], np.nan, 0.0
    buy, sell, eb, es, pb, tb, ts, nb, shares = [], [], np.nan, np.nan, np.nan, 0.0, 0.0, 0, []
    for i, (p, v) in enumerate(zip(prices, volumes)):
        sign = sign if last is None or p == last else (1 if p > last else -1)
        last = p
        x = sign * {"tick": 1, "volume": v, "dollar": p * v}[metric]
        n += 1
        if kind == "imbalance":
            imb.append(x)
            theta += x
            if not ends and np.isnan(exp) and len(imb) >= T:
                exp = plain_ewma(imb[-e.window :], min(len(imb), e.window))
            hit = abs(theta) > T * abs(exp)
        else:
            if x > 0:
                buy.append(x)
                tb += x
                nb += 1
            elif x < 0:
                sell.append(-x)
                ts -= x
            if not ends and (np.isnan(eb) or np.isnan(es)):
                eb = plain_ewma(buy[-e.window :], min(len(buy), e.window)) if len(buy) >= T else np.nan
                es = plain_ewma(sell[-e.window :], min(len(sell), e.window)) if len(sell) >= T else np.nan
                if not np.isnan(eb) and not np.isnan(es):
                    pb = nb / n
            hit = max(tb, ts) > T * max(eb * pb, es * (1 - pb)) if not np.isnan(eb * pb * es) else False
        if hit:
            ends.append(i + 1)
            lengths.append(n)
            shares.append(nb / n)
            if not e.constant:
                T = min(max(plain_ewma(lengths[-e.previous_bars :], e.previous_bars), e.bounds[0]), e.bounds[1])
            if kind == "imbalance":
                exp = plain_ewma(imb[-e.window :], min(len(imb), e.window)) if len(imb) >= T else np.nan
            else:
                pb = plain_ewma(shares[-e.previous_bars :], e.previous_bars)
                eb, es = plain_ewma(buy[-e.window :], min(len(buy), e.window)), plain_ewma(sell[-e.window :], min(len(sell), e.window))
            theta = tb = ts = 0.0
            n = nb = 0
    return ends


@pytest.mark.parametrize("kind", ["imbalance", "run"])
@pytest.mark.parametrize("metric", B.METRICS)
@pytest.mark.parametrize("constant", [True, False])
def test_machines_match_the_plain_loop(kind, metric, constant):
    rng = random.Random(f"{kind}{metric}{constant}")
    prices = np.round(50 + np.cumsum([rng.choice([-0.5, 0, 0.5, 0.25]) for _ in range(3000)]), 2)
    volumes = np.array([float(rng.randrange(1, 20)) for _ in prices])
    e = B.Expectation(window=50, ticks=20, previous_bars=3, bounds=(5, 60), constant=constant)
    want = plain_bars(kind, metric, e, prices.tolist(), volumes.tolist())
    assert len(want) > 5
    for batches in (1, 7, 100):
        m = (B.ImbalanceBars if kind == "imbalance" else B.RunBars)(metric, e)
        got = []
        for part in np.array_split(np.arange(len(prices)), batches):  # state carries over batches
            out = m.feed({"ts": part, "price": prices[part], "volume": volumes[part]})
            got += out["tick_num"].astype(int).tolist() if out else []
        assert got == want, batches


def test_bars_of_several_series_and_empty(spark):
    df = ticks(spark, range(50), instrument=1).unionByName(ticks(spark, range(50), instrument=None)).unionByName(ticks(spark, [1], instrument=3))
    out = B.volume_bars(df, threshold=10).groupBy("instrument").count().collect()
    assert {r.instrument: r["count"] for r in out} == {1: 5, None: 5}
    empty = spark.createDataFrame([], SCHEMA)
    assert B.volume_bars(empty, threshold=10).count() == 0 and B.tick_bars(empty).count() == 0 and B.time_bars(empty).count() == 0
    with pytest.raises(ValueError):
        B.ThresholdBars("price", 1)


def test_features_of_bars(spark):
    from pyspark.sql import functions as F

    df = ticks(spark, range(1, 21), [2.0] * 20)
    bars = B.volume_bars(df, threshold=10)
    out = B.bars_with_features(df, bars, [B.BarFeature("top", F.max("price")), B.BarFeature("n", F.count("price"))]).orderBy("tick_num").collect()
    assert [(r.tick_num, r.top, r.n) for r in out] == [(5, 5, 5), (10, 10, 5), (15, 15, 5), (20, 20, 5)]
