"""The general data-cleaning operators against brute force and on awkward rows."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.selection import exact_median
from barloom.operators.grid import regular_grid
from barloom.operators.periods import interval_gaps, merge_intervals
from barloom.operators.spikes import Ellipsoid, Measure, flag_readings, phase_points, spikes
from barloom.operators.trailing import trailing_totals

UTC = dt.timezone.utc
T0 = dt.datetime(2020, 1, 6, tzinfo=UTC)
BARS = "instrument long, seq long, date_time timestamp, high double, low double, close double, volume double, cum_dollar_value double, _slot string, `_day` string"


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def bar(i, seq, m, close, volume=1.0):
    return (i, seq, None if m is None else minutes(m), None, None, close, volume, None, "x", "y")


# Grid.


def test_grid_fills_between_observations_of_a_day(spark):
    rows = [bar(1, 1, 5, 10.0), bar(1, 2, 95, 14.0), bar(1, 3, 24 * 60 + 5, 20.0), bar(1, 4, 24 * 60 + 65, 20.0)]
    out = regular_grid(spark.createDataFrame(rows, BARS)).orderBy("slot_start").collect()
    start = int(T0.timestamp())
    assert [(r.slot_start - start) // 1800 for r in out] == [0, 1, 2, 3, 48, 49, 50]
    assert [r.close_source for r in out] == ["observed", "modelled", "modelled", "observed", "observed", "modelled", "observed"]
    assert out[0].close == 10.0 and out[1].close is None and out[1].close_filled is not None
    assert all(r.volume_filled >= 0 for r in out)


def test_grid_nulls_ties_repeats_and_late_rows(spark):
    rows = [
        bar(1, 5, 70, 3.0), bar(1, 1, 0, None), bar(1, 2, 31, 1.0), bar(1, 3, 31, 2.0), bar(1, 3, 31, 2.0), bar(1, 4, None, 9.0),
        bar(None, 1, 10, 5.0), bar(None, 2, 130, 5.0), bar(2, 1, 10, float("nan")), bar(2, 2, 80, 4.0), bar(3, 1, 10, None),
    ]
    out = regular_grid(spark.createDataFrame(rows, BARS)).collect()
    by = {(r.instrument, (r.slot_start - int(T0.timestamp())) // 1800): r for r in out}
    assert by[1, 0].close is None and by[1, 0].close_source == "open" and by[1, 0].close_filled is None
    assert by[1, 1].close == 2.0 and by[1, 1].volume == 3.0  # the last by (time, seq); repeats add to totals
    assert by[None, 2].close_source == "modelled" and math.isfinite(by[None, 2].close_filled)
    assert math.isnan(by[2, 0].close) and by[2, 0].close_source == "observed" and math.isfinite(by[2, 1].close_filled)
    assert by[3, 0].close_source == "open"


def test_grid_empty_and_bad_arguments(spark):
    empty = spark.createDataFrame([], BARS)
    assert regular_grid(empty).count() == 0
    with pytest.raises(ValueError):
        regular_grid(empty, last=("close",), total=("close",))
    with pytest.raises(ValueError):
        regular_grid(empty, step_seconds=7)


def test_grid_recovers_trend_and_season(spark):
    rng = random.Random(1)
    truth = lambda s: 100 + 0.5 * s / 48 + 3 * math.cos(2 * math.pi * s / 48) + 2 * math.sin(4 * math.pi * s / 48)
    rows = [bar(1, s, 30 * s + 3, truth(s)) for s in range(48 * 20) if s % 48 in (0, 47) or rng.random() < 0.5]
    out = regular_grid(spark.createDataFrame(rows, BARS), total=()).where("close_source = 'modelled'").collect()
    assert len(out) > 300
    assert max(abs(r.close_filled - truth((r.slot_start - int(T0.timestamp())) // 1800)) for r in out) < 1e-3


# Periods.

EVENTS = "instrument long, t0 timestamp, t1 timestamp, _s int"


def brute_periods(rows):
    out = {}
    for k in {r[0] for r in rows}:
        spans = sorted((a, b) for i, a, b in rows if i == k and a is not None and b is not None and b >= a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2] + 1)
            else:
                merged.append((a, b, 1))
        out[k] = merged
    return out


def test_periods_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        a = rng.randrange(0, 60 * 24 * 40)
        b = None if rng.random() < 0.05 else a + rng.choice([-5, 0, 1, 10, 60, 600, 4000])
        rows.append((rng.choice([1, 1, 1, 1, 2, None]), a, b))
    rows += [(1, 100, 200)] * 50
    df = spark.createDataFrame([(k, minutes(a), None if b is None else minutes(b), 0) for k, a, b in rows] + [(1, None, minutes(3), 0)], EVENTS)
    periods = merge_intervals(df)
    got = {}
    for r in periods.orderBy("instrument", "period").collect():
        a, b = (int((x.replace(tzinfo=UTC) - T0).total_seconds() // 60) for x in (r.period_start, r.period_end))
        got.setdefault(r.instrument, []).append((a, b, r.n_intervals))
    want = brute_periods(rows)
    assert got == {k: v for k, v in want.items() if v}
    gaps = {(r.instrument, r.gap_start, r.gap_end) for r in interval_gaps(periods).collect()}
    assert len(gaps) == sum(len(v) - 1 for v in want.values() if v)


def test_periods_touch_nest_and_empty(spark):
    df = spark.createDataFrame([(1, minutes(0), minutes(10), 0), (1, minutes(10), minutes(20), 0), (1, minutes(2), minutes(3), 0), (1, minutes(25), minutes(25), 0)], EVENTS)
    out = merge_intervals(df).orderBy("period").collect()
    assert [(r.period_start.minute, r.period_end.minute) for r in out] == [(0, 20), (25, 25)]
    assert interval_gaps(merge_intervals(df), max_days=1).count() == 1
    assert interval_gaps(merge_intervals(df), max_days=1e-4).count() == 0
    assert merge_intervals(spark.createDataFrame([], EVENTS)).count() == 0


# Trailing totals.

DAILY = "instrument long, ts timestamp, Close double, Volume double, seq long, _d string, day string"


def test_trailing_matches_brute_force(spark):
    rng = random.Random(5)
    rows, seq = [], 0
    for k in (1, 2, None):
        for d in range(0, 90):
            if rng.random() < 0.6:
                for _ in range(rng.choice([1, 1, 2])):
                    seq += 1
                    rows.append((k, T0 + dt.timedelta(days=d, hours=rng.randrange(24)), None if rng.random() < 0.1 else round(rng.uniform(1, 9), 2), None if rng.random() < 0.1 else float(rng.randrange(1000)), seq, "", ""))
    rng.shuffle(rows)
    rows.append((1, None, 1.0, 1.0, 0, "", ""))
    out = trailing_totals(spark.createDataFrame(rows, DAILY), days=(1, 5, 7, 30), scale={"Close": 100, "Volume": 1}).collect()
    latest = {}
    for k, ts, c, v, s, *_ in rows:
        if ts is not None and s >= latest.get((k, ts.date()), (-1,))[0]:
            latest[k, ts.date()] = (s, c, v)
    for r in out:
        for n in (1, 5, 7, 30):
            days = [latest[r.instrument, r.day - dt.timedelta(days=i)] for i in range(n) if (r.instrument, r.day - dt.timedelta(days=i)) in latest]
            vs, cs = [x[2] for x in days if x[2] is not None], [x[1] for x in days if x[1] is not None]
            assert r[f"Volume_sum_{n}"] == sum(vs) and r[f"Volume_count_{n}"] == len(vs)
            assert r[f"Close_count_{n}"] == len(cs) and (r[f"Close_avg_{n}"] is None) == (not cs)
            if cs:
                assert abs(r[f"Close_avg_{n}"] - sum(cs) / len(cs)) < 1e-9
    spans = {}
    for k, d in latest:
        spans.setdefault(k, []).append(d)
    assert len(out) == sum((max(v) - min(v)).days + 1 for v in spans.values())


def test_trailing_edge_values(spark):
    rows = [(1, T0, float("nan"), float("inf"), None, "", ""), (1, T0, 2.0, 3.0, 5, "", ""), (2, T0, float("nan"), None, 1, "", "")]
    out = {r.instrument: r for r in trailing_totals(spark.createDataFrame(rows, DAILY)).collect()}
    assert out[1].Close_avg_7 == 2.0 and out[1].Volume_sum_30 == 3.0
    assert out[2].Close_avg_7 is None and out[2].Volume_sum_7 == 0
    assert trailing_totals(spark.createDataFrame([], DAILY)).count() == 0
    with pytest.raises(ValueError):
        trailing_totals(spark.createDataFrame([], DAILY), days=(0,))


# Medians and spikes.


def test_exact_median(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x)) for k, n in ((1, 999), (2, 1000), (3, 1), (4, 2)) for x in np.round(rng.standard_t(2, n) * 10.0 ** rng.integers(-3, 6, n), 3)]
    rows += [(5, 7.0)] * 40 + [(6, None), (6, float("nan")), (None, 1.0), (None, 2.0), (7, -0.0), (7, 0.0), (7, 1e-300), (8, 5e-324), (8, 1e-323), (9, -1.7e308), (9, 1.7e308), (9, 1.6e308)]
    out = {r.k: (r.median, r.n) for r in exact_median(spark.createDataFrame(rows, "k long, x double"), ["k"], "x", per_octave=4, parts=8).collect()}
    want = {}
    for k, x in rows:
        if x is not None and x == x:
            want.setdefault(k, []).append(x)
    assert set(out) == set(want)
    for k, xs in want.items():
        assert out[k] == (statistics.median(xs), len(xs)), k


def brute_faults(rows, neighbours, limit, stuck):
    """Positions that differ from the median of the neighbours on both sides, or lie in a run."""
    xs = [r[1] for r in rows]
    off, runs = set(), set()
    for i in range(len(xs)):
        if neighbours <= i < len(xs) - neighbours:
            a, b = statistics.median(xs[i - neighbours : i]), statistics.median(xs[i + 1 : i + 1 + neighbours])
            if abs(xs[i] - a) > limit * abs(a) and abs(xs[i] - b) > limit * abs(b):
                off.add(rows[i][0])
    i = 0
    while i < len(xs):
        j = i
        while j < len(xs) and xs[j] == xs[i]:
            j += 1
        if j - i >= stuck:
            runs |= {rows[k][0] for k in range(i, j)}
        i = j
    return off, runs


def test_spikes_hold_every_case_across_blocks(spark):
    rng = random.Random(9)
    rows, price, t = [], 50.0, 0
    for seq in range(2500):
        t += rng.choice([0, 1, 5, 300])
        price = price if 400 < seq < 420 or 995 < seq < 1006 else round(max(1.0, price + rng.gauss(0, 0.3)), 2)
        x = round(price * rng.choice([0.5, 1.2, 3.0]), 2) if rng.random() < 0.02 else price
        rows.append((seq, x if rng.random() > 0.01 else None, t))
    df = spark.createDataFrame([bar(1, s, m, x, 100.0 + s) for s, x, m in rows] + [bar(2, s, s, 5.0) for s in range(7)], BARS)
    out = flag_readings(df, [Measure("close", 10, 8)], block_rows=100).collect()
    off, runs = brute_faults([(s, x) for s, x, m in sorted(rows, key=lambda r: (r[2], r[0])) if x is not None], 10, 0.1, 8)
    outside = {r.seq for r in out if r.fault == "spike" and r.instrument == 1}
    exact = {r.seq for r in out if r.fault == "spike" and r.instrument == 1 and r.usual_before is not None and r.usual_after is not None and abs(r.reading - r.usual_before) > 0.1 * r.usual_before and abs(r.reading - r.usual_after) > 0.1 * r.usual_after}
    assert off and off <= outside and exact == off
    assert {r.seq for r in out if r.fault == "stuck" and r.instrument == 1} == runs and runs
    assert not [r for r in out if r.instrument == 2 and r.fault == "stuck"]  # seven in a row are no run of eight
    whole = flag_readings(df, [Measure("close", 10, 8)], block_rows=100_000).collect()
    key = lambda r: (r.instrument, r.seq, r.fault, r.reading, r.usual_before, r.usual_after)
    assert sorted(map(str, map(key, whole))) == sorted(map(str, map(key, out)))


def test_spikes_awkward_rows(spark):
    rows = [bar(1, s, s, x) for s, x in enumerate([1.0, None, float("nan"), -3.0, 0.0, 2.0])] + [bar(None, 1, 1, 4.0), bar(1, 99, None, 4.0), bar(1, 5, 5, 2.0)]
    df = spark.createDataFrame(rows, BARS)
    bounds = {"negative": F.col("close") <= 0, "never": F.lit(None).cast("boolean")}
    out = flag_readings(df, [Measure("close"), Measure("volume", None)], bounds=bounds).where("fault = 'bounds'").collect()
    assert sorted(r.seq for r in out) == [3, 4] and {r.rule for r in out} == {"negative"}
    empty = spark.createDataFrame([], BARS)
    assert flag_readings(empty, [Measure("close"), Measure("volume", None)], bounds=bounds).count() == 0


def test_volume_far_above_the_median_is_always_flagged(spark):
    rng = random.Random(4)
    vols = [float(rng.randrange(1, 2000)) for _ in range(800)]
    df = spark.createDataFrame([bar(1, s, s, 1.0, v) for s, v in enumerate(vols)] + [bar(2, s, s, 1.0, 0.0 if s else 5.0) for s in range(5)], BARS)
    out = flag_readings(df, [Measure("volume", None, 8)]).where("fault = 'spike'").collect()
    m = statistics.median(vols)
    assert {s for s, v in enumerate(vols) if v > 20 * m} <= {r.seq for r in out if r.instrument == 1}
    assert {r.seq for r in out if r.instrument == 2 and r.reading > 0} == {0}  # a median of 0: any volume is far above


def heavy_tailed(spark, seed=11, n=2000):
    rng = random.Random(seed)
    heavy = lambda: 0.01 * math.tan(math.pi * (rng.random() - 0.5))
    rows = [bar(1, s, s, 50.0 * math.exp(max(-9, min(9, heavy()))), float(rng.randrange(500))) for s in range(n)]
    return rows, spark.createDataFrame(rows + [bar(None, s, s, 5.0 + 0.01 * (s % 7), 0.0 if s % 3 else 4.0) for s in range(300)], BARS)


def flagged(df, e=Ellipsoid(), block_rows=250_000, measures=(Measure("close", 10, 8), Measure("volume", None, 8))):
    return sorted(map(str, flag_readings(df, measures, ellipsoid=e, block_rows=block_rows).collect()))


def test_spike_rounds_go_on_until_nothing_new_is_flagged(spark):
    rows, _ = heavy_tailed(spark)
    points = phase_points(np.array([r[5] for r in rows]), Measure("close", 10, 8))
    v, d1, d2 = (points[c] for c in ("_v", "_d1", "_d2"))
    out = spikes(v, d1, d2)
    assert 0 < out.sum() < 2000
    sd = lambda c: 1.4826 * np.median(np.abs(c[~np.isnan(c)]))
    left = [c[~out] for c in (v, d1, d2)]
    a, b, c = (x / sd(x) for x in left)
    p, q = (a + c) / math.sqrt(2), (a - c) / math.sqrt(2)
    assert not ((np.abs(a) > 3) & ((p / sd(p)) ** 2 + (q / sd(q)) ** 2 + b**2 > 2 * math.log(len(a)))).any()


def test_spike_rounds_and_differences_decide(spark):
    _, df = heavy_tailed(spark)
    whole = flagged(df)
    assert set(flagged(df, Ellipsoid(rounds=1))) < set(whole)
    assert flagged(df, Ellipsoid(differences=False)) != whole
    assert set(flagged(df, Ellipsoid(protect=6.0))) < set(whole)


@pytest.mark.parametrize("e", [Ellipsoid(), Ellipsoid(rounds=2), Ellipsoid(differences=False)])
def test_sources_too_large_for_a_task_give_the_same_spikes(spark, e):
    _, df = heavy_tailed(spark, 5, 900)
    assert flagged(df, e, block_rows=250) == flagged(df, e)


def test_bar_flags_test_dollar_value(spark, monkeypatch):
    from barloom.plans import cleaning

    seen = []
    monkeypatch.setattr(cleaning, "table", lambda *a: None)
    monkeypatch.setattr(cleaning, "flag_readings", lambda df, measures, bounds: seen.extend(m.column for m in measures))
    cleaning.p4_flags(spark, "")
    assert seen == ["close", "volume", "cum_dollar_value"]
