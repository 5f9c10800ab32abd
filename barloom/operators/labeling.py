"""Labels: vertical and triple barriers, meta-labels, trend scanning, tail sets. Times are epoch microseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.joins import asof_join, range_join
from barloom.ordering import DAY_US, HOUR_US, Staged
from barloom.shared import materialize


def vertical_barriers(events: DataFrame, prices: DataFrame, keys: Sequence[str], horizon_us: int, t0: str = "t0", ts: str = "ts") -> DataFrame:
    """events with ``vertical``: the first price time at or after t0 + horizon. Events past the last price are dropped."""
    due = events.withColumn("_due", F.col(t0) + F.lit(horizon_us))
    p = prices.select(*keys, F.col(ts).alias("_p"), F.col(ts).alias("vertical"))
    return asof_join(due, p, keys, "_due", "_p", ["vertical"], forward=True).where(F.col("vertical").isNotNull()).drop("_due")


def price_at(events: DataFrame, prices: DataFrame, keys: Sequence[str], at: str, out: str, ts: str = "ts", close: str = "close") -> DataFrame:
    """events with ``out``: the price at the first time at or after ``at``."""
    p = prices.select(*keys, F.col(ts).alias("_p"), F.col(close).alias(out))
    return asof_join(events, p, keys, at, "_p", [out], forward=True)


def _narrowed(spans: DataFrame, prices: DataFrame, keys: Sequence[str], cell_us: int) -> DataFrame:
    """Of the time spans [_a, _b] of events the parts, each within a calendar cell, that can hold a first touch: from the cells' least and greatest price, the first cell
    inside the span that passes each barrier (its extreme price does, so it holds a touch), and the span's two edge cells where they may. No event meets
    a price, and at most four parts of a span are left."""
    cells = prices.groupBy(*keys, F.floor(F.col("_ts") / cell_us).alias("_cell")).agg(F.min("_close").alias("_low"), F.max("_close").alias("_high"))
    each = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell_us), F.floor(F.col("_b") / cell_us))))
    l, r = each.alias("l"), cells.alias("r")
    both = l.join(r, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_cell"]]).select("l.*", "r._low", "r._high")
    lo, hi = _signed(F.col("_low")), _signed(F.col("_high"))
    up, down = _passes_up(F.greatest(lo, hi)), _passes_down(F.least(lo, hi))
    inside = (F.col("_cell") * cell_us >= F.col("_a")) & ((F.col("_cell") + 1) * cell_us - 1 <= F.col("_b"))
    edge = F.when(~inside & (up | down), F.col("_cell"))
    columns = [c for c in spans.columns if c not in ("_a", "_b")]
    some = both.groupBy(*columns, "_a", "_b").agg(F.array_compact(F.array_distinct(F.array(F.min(edge), F.max(edge), F.min(F.when(inside & up, F.col("_cell"))), F.min(F.when(inside & down, F.col("_cell")))))).alias("_cells"))
    open_ = some.withColumn("_cell", F.explode("_cells"))
    return open_.select(*columns, F.greatest(F.col("_a"), F.col("_cell") * cell_us).alias("_a"), F.least(F.col("_b"), (F.col("_cell") + 1) * cell_us - 1).alias("_b"))


def _signed(close: Column) -> Column:
    """The signed return since the start; it rises or falls with the price throughout, so extreme prices have the extreme returns."""
    return (F.try_divide(close, F.col("_p0")) - 1) * F.col("side")


def _passes_up(r: Column) -> Column:
    return F.coalesce((F.col("pt") > 0) & (r > F.col("pt") * F.col("trgt")), F.lit(False))


def _passes_down(r: Column) -> Column:
    return F.coalesce((F.col("sl") > 0) & (r < -F.col("sl") * F.col("trgt")), F.lit(False))


def first_touches(prices: DataFrame, events: DataFrame, keys: Sequence[str], ts: str = "ts", close: str = "close", cells_us: Sequence[int] = (DAY_US, HOUR_US)) -> DataFrame:
    """events with ``entry`` and ``vertical_price`` (the first prices at or after t0 and t1), ``pt_time`` and ``sl_time``: the first price times in [t0, t1] whose signed return
    passes +pt x trgt or -sl x trgt, and ``pt_price`` and ``sl_price``, the prices there. events have t0, t1 (null: to the series' end), trgt, side, pt and sl (a multiple of 0 or less sets no barrier); t0 is unique in a series.

    Spans are narrowed by calendar cells, coarse to fine, before any price is looked at: an event meets the prices of a few of the finest cells."""
    p = prices.select(*keys, F.col(ts).alias("_ts"), F.col(close).alias("_close"))
    last = p.groupBy(*keys).agg(F.max("_ts").alias("_last"))
    # Both ends are looked up in one pass.
    ends = events.withColumn("_at", F.explode(F.array_distinct(F.array_compact(F.array("t0", "t1")))))
    found = price_at(ends, prices, keys, "_at", "_x", ts, close).groupBy(*keys, "t0").agg(F.first(F.struct(*events.columns)).alias("_e"), F.max(F.when(F.col("_at") == F.col("t0"), F.col("_x"))).alias("entry"), F.max(F.when(F.col("_at") == F.col("t1"), F.col("_x"))).alias("vertical_price"))
    e = found.select(*[F.col(f"_e.{c}").alias(c) for c in events.columns], "entry", "vertical_price")
    l, r = e.alias("l"), last.alias("r")
    e = l.join(r, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left").select("l.*", F.coalesce("l.t1", "r._last").alias("_b"))
    # Used by every narrowing and once more: written once.
    e = materialize(e, "events")
    spans = e.where(F.col("_b") >= F.col("t0")).select(*keys, "t0", "trgt", "side", "pt", "sl", F.col("entry").alias("_p0"), F.col("t0").alias("_a"), "_b")
    for cell in cells_us:
        spans = _narrowed(spans, p, keys, cell)
    pairs = range_join(p, spans, keys, "_ts", "_a", "_b", cells_us[-1])
    r = _signed(F.col("_close"))
    at = F.struct(F.col("_ts").alias("time"), F.col("_close").alias("price"))
    hits = pairs.groupBy(*keys, "t0").agg(F.min(F.when(_passes_up(r), at)).alias("_pt"), F.min(F.when(_passes_down(r), at)).alias("_sl"))
    l, h = e.drop("_b").alias("l"), hits.alias("h")
    return l.join(h, [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "t0"]], "left").select("l.*", *[F.col(f"h._{k}.{c}").alias(f"{k}_{c}") for k in ("pt", "sl") for c in ("time", "price")])


def triple_barrier(prices: DataFrame, events: DataFrame, keys: Sequence[str], min_return: float = 0.0, symmetric: bool = False, cells_us: Sequence[int] = (DAY_US, HOUR_US)) -> DataFrame:
    """events whose target exceeds ``min_return``, with ``touch``: the first of the vertical barrier t1, profit taking and stop loss, null where
    there is none, ``entry``, the price at t0, and ``exit``, that at the touch. ``symmetric`` (no side given) takes side 1 and pt for both barriers; reported pt and sl stay as given."""
    e = events.where(F.col("trgt") > min_return)
    given = {f"_given_{c}": F.col(c) for c in ("side", "sl")}
    use = e.withColumns(given).withColumns({"side": F.lit(1.0), "sl": F.col("pt")}) if symmetric else e
    hits = first_touches(prices, use, keys, cells_us=cells_us)
    if symmetric:
        hits = hits.withColumns({c: F.col(f"_given_{c}") for c in ("side", "sl")})
    touch = F.least("t1", "pt_time", "sl_time")
    exit_price = F.when(F.col("pt_time") == touch, F.col("pt_price")).when(F.col("sl_time") == touch, F.col("sl_price")).when(F.col("t1") == touch, F.col("vertical_price"))
    return hits.select(*e.columns, "entry", touch.alias("touch"), exit_price.alias("exit"))


def barrier_outcome(ret: Column, trgt: Column, pt: Column, sl: Column) -> Column:
    """1 or -1 where the log return passes its barrier, else 0."""
    return F.when((ret > 0) & (ret > trgt * pt), 1).when((ret < 0) & (ret < -trgt * sl), -1).otherwise(0)


def meta_labels(prices: DataFrame, barriers: DataFrame, keys: Sequence[str], with_side: bool = True) -> DataFrame:
    """keys, t0, ``ret``, trgt, ``bin`` and side of the events that touched a barrier and have prices. With a side, bin is 0 where the signed return isn't
    positive."""
    e = barriers.where(F.col("touch").isNotNull())
    for name, at in (("entry", "t0"), ("exit", "touch")):  # barriers that are not from triple_barrier may lack them
        e = e if name in e.columns else price_at(e, prices, keys, at, name)
    e = e.where(F.col("entry").isNotNull() & F.col("exit").isNotNull())
    log = F.ln(F.try_divide("exit", "entry")) * (F.col("side") if with_side else F.lit(1.0))
    out = barrier_outcome(F.col("_log"), F.col("trgt"), F.col("pt"), F.col("sl"))
    out = F.when(F.col("_log") <= 0, 0).otherwise(out) if with_side else out
    return e.withColumn("_log", log).select(*keys, "t0", (F.exp("_log") - 1).alias("ret"), "trgt", out.alias("bin"), *(["side"] if with_side else []))


def drop_rare_labels(labels: DataFrame, label: str = "bin", min_share: float = 0.05) -> DataFrame:
    """Without the rarest classes, until each has more than ``min_share`` or fewer than three are left. Only the classes' counts, a handful
    of rows, come to the driver."""
    counts = {r[0]: r[1] for r in labels.groupBy(label).count().collect()}
    dropped = []
    while len(counts) >= 3:
        rare = min(counts, key=lambda k: (counts[k], str(k)))
        if counts[rare] / sum(counts.values()) > min_share:
            break
        dropped.append(rare)
        del counts[rare]
    return labels.where(~F.col(label).isin(dropped)) if dropped else labels


def trend_t_value(n: int, sy: Column, sty: Column, syy: Column) -> Column:
    """t statistic of the slope of y on 0 .. n - 1, from the sums of y, t y and y y; null for an exact line."""
    st, stt = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    sxx = stt - st * st / n
    sxy = sty - st * sy / n
    slope = sxy / sxx
    sse = F.greatest(syy - sy * sy / n - slope * sxy, F.lit(0.0))
    return F.when(sse > 1e-10 * F.abs(syy), slope / F.sqrt(sse / (n - 2) / sxx))


def trend_scan(s: Staged, close: str, order: str, horizons: Sequence[int]) -> Staged:
    """Forward-looking trend labels: over each horizon the slope's t value; ``t_value`` is the one of largest size, ``bin`` its sign, ``horizon``
    where it was found and ``t1`` the end of the last horizon. Null where the longest horizon isn't there."""
    longest = max(horizons)
    # Against the current row's close, so that the sums stay small.
    values = F.collect_list(F.col(close)).over(s.w.rowsBetween(0, longest - 1))
    s.let(_path=F.when(F.count(close).over(s.w.rowsBetween(0, longest - 1)) == longest, F.transform(values, lambda x: x - F.get(values, F.lit(0)))))

    def total(h: int, f) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(h - 1)), F.lit(0.0), lambda a, i: a + f(F.get("_path", i), i.cast("double")))

    tests = []
    for h in horizons:
        t = trend_t_value(h, total(h, lambda y, i: y), total(h, lambda y, i: y * i), total(h, lambda y, i: y * y))
        tests.append(F.struct(F.abs(F.coalesce(t, F.lit(0.0))).alias("size"), F.lit(-h).alias("first"), F.coalesce(t, F.lit(0.0)).alias("t")))
    s.let(_best=F.when(F.col("_path").isNotNull(), F.array_max(F.array(*tests))), _t1=s.lead(order, longest - 1))
    t = F.col("_best.t")
    return s.let(t_value=t, horizon=-F.col("_best.first"), bin=F.when(t > 0, 1).when(t < 0, -1).when(t == 0, 0), t1=F.when(t.isNotNull(), F.col("_t1")))


def tail_sets(returns: DataFrame, date: str, asset: str, value: str, q: int = 10) -> DataFrame:
    """date, asset and ``tail``: 1 in the top q-quantile of the date's cross-section, -1 in the bottom one, else 0. Nulls take no part. The
    edges are aggregates per date, joined back."""
    rows = returns.where(F.col(value).isNotNull())
    edges = rows.groupBy(date).agg(F.percentile(value, F.lit(1 / q)).alias("_low"), F.percentile(value, F.lit(1 - 1 / q)).alias("_high"))
    tail = F.when(F.col(value) <= F.col("_low"), -1).when(F.col(value) > F.col("_high"), 1).otherwise(0)
    return rows.join(edges, date).select(date, asset, tail.alias("tail"))


def tail_members(tails: DataFrame, date: str, asset: str) -> DataFrame:
    """date, ``positive`` and ``negative``: the names in the tails, sorted."""
    names = lambda k: F.sort_array(F.collect_list(F.when(F.col("tail") == k, F.col(asset))))
    return tails.groupBy(date).agg(names(1).alias("positive"), names(-1).alias("negative"))


def directional_dataset(s: Staged, value: str, lags: Sequence[int] = (1, 2, 5)) -> Staged:
    """Next-period target of a return series: ``target`` (1 if the next value is positive), ``target_ret`` and the lagged values."""
    nxt = s.lead(value)
    return s.let(target=F.when(nxt > 0, 1).when(nxt.isNotNull(), 0), target_ret=nxt, **{f"lag_{k}": s.lag(value, k) for k in lags})
