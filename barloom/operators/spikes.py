"""Implausible readings: spikes, stuck values and impossible values, per source.

Spikes by phase-space thresholding. A reading is a point: its deviation from the source's usual value, and the first and second
difference of its logarithm. Deviation and second difference go together (a spike of s has a second difference near -2 s, and
so has noise), so the two are put into units of their own scale and rotated by 45 degrees, the directions in which two such
coordinates vary most and least. The half-axes are sqrt(2 ln n) robust standard deviations (1.4826 x the exact median of the
absolute values) of the two rotated coordinates and of the first difference. A reading outside of the ellipsoid is a spike
if its own deviation is beyond ``protect`` robust standard deviations: the neighbours of a spike have its differences without
being wrong, and so has the first reading of a lasting change. Spikes are taken out, which shrinks the ellipsoid, and so on until
nothing new is flagged. Stuck values are runs of zero differences, impossible values break bounds given as expressions.

Scale: a source of at most ``block_rows`` readings is one group of numpy arrays, so all of its rounds take one shuffle. A larger
source is cut into blocks with halo rows (barloom.ordering) that many tasks turn into points; each of its rounds takes exact
medians by counts of bins (barloom.functions.selection), and no task holds the source. Both ways flag the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.fold import groups
from barloom.functions.selection import exact_median
from barloom.ordering import in_blocks, with_position
from barloom.shared import materialize, small_side

#: Readings of one source that a task holds at once: about a dozen arrays of this length.
BLOCK_ROWS = 250_000
ROBUST = 1.4826
POINT = "_x double, _before double, _after double, _v double, _d1 double, _d2 double, _stuck boolean"


@dataclass(frozen=True)
class Measure:
    """``neighbours``: the usual value is the median of so many readings before, and of as many after; the nearer one counts.
    None: it is the source's median, and the deviation is the logarithm of the ratio to it (infinite for a positive reading where
    that median is at or below 0; none for other readings at or below 0). ``stuck``: shortest run of equal readings that is a fault."""

    column: str
    neighbours: int | None = 10
    stuck: int = 8


@dataclass(frozen=True)
class Ellipsoid:
    """``protect``: least own deviation of a spike, in robust standard deviations; ``floor``: least robust standard deviation of a coordinate;
    ``rounds``: at most so many (None: until nothing new is flagged); ``differences``: whether the differences are coordinates."""

    protect: float = 3.0
    floor: float = 2e-4
    rounds: int | None = None
    differences: bool = True


def _same(keys: Sequence[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def _off(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(x - m) / |m|; a reading other than 0 is infinitely far from 0."""
    return np.where(m != 0, (x - m) / np.abs(m), np.where(np.isnan(m), np.nan, np.where(x == 0, 0.0, np.sign(x) * np.inf)))


def phase_points(x: np.ndarray, m: Measure, median: float | None = None) -> dict[str, np.ndarray]:
    """The points of a source's readings in order (none is NaN): the columns of ``POINT``, NaN where a coordinate is missing.
    ``median``: the source's, where ``x`` is only a part of it."""
    n, nan = len(x), np.nan
    with np.errstate(all="ignore"):
        log = np.where(x > 0, np.log(x), nan)
        d1, d2 = np.full(n, nan), np.full(n, nan)
        d1[1:] = log[1:] - log[:-1]
        d2[1:-1] = log[2:] - 2 * log[1:-1] + log[:-2]
        if k := m.neighbours:
            before, after = np.full(n, nan), np.full(n, nan)
            if n > k:
                windows = np.sort(np.lib.stride_tricks.sliding_window_view(x, k), axis=1)
                mid = (windows[:, (k - 1) // 2] + windows[:, k // 2]) / 2
                before[k:], after[:-k] = mid[:-1], mid[1:]
            b, a = _off(x, before), _off(x, after)
            v = np.where(np.isnan(b), a, np.where(np.isnan(a) | (np.abs(b) <= np.abs(a)), b, a))
        else:
            median = np.median(x) if median is None else median
            before = after = np.full(n, median)
            ratio = np.where(x > 0, np.log(x / median) if median > 0 else np.inf, nan)
            v = np.where(x == median, 0.0, ratio)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if n else np.zeros(0, dtype=int)
    length = np.diff(np.append(edge, n))
    return {"_x": x, "_before": before, "_after": after, "_v": v, "_d1": d1, "_d2": d2, "_stuck": np.repeat(length >= m.stuck, length)}


def spikes(v: np.ndarray, d1: np.ndarray, d2: np.ndarray, e: Ellipsoid = Ellipsoid()) -> np.ndarray:
    """Which points of a source are spikes."""
    if not e.differences:
        d1, d2 = np.full(len(v), np.nan), np.full(len(v), np.nan)
    left, found, done = np.arange(len(v)), np.zeros(len(v), dtype=bool), 0

    def deviation(c: np.ndarray) -> float:
        c = np.abs(c[np.isfinite(c)])
        return max(ROBUST * float(np.median(c)), e.floor) if len(c) else e.floor

    with np.errstate(invalid="ignore", over="ignore"):
        while len(left) and (e.rounds is None or done < e.rounds):
            a, b, c = v[left], d1[left], d2[left]
            s = deviation(a)
            a, b, c = a / s, b / deviation(b), c / deviation(c)
            p, q = (a + c) * math.sqrt(0.5), (a - c) * math.sqrt(0.5)
            sp, sq = (deviation(z) for z in (p, q))
            p, q = (np.where(np.isnan(c), a * math.sqrt(0.5), z) for z in (p, q))
            radius = sum(np.where(np.isnan(z), 0.0, z * z) for z in (p / sp, q / sq, b))
            new = (np.abs(a) > e.protect) & ((radius > 2 * math.log(max(len(left), 2))) | np.isinf(a))
            if not new.any():
                break
            found[left[new]] = True
            left, done = left[~new], done + 1
    return found


def _values(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a reading, and the readings."""
    x = table.column(name).to_numpy()
    at = np.flatnonzero(~np.isnan(x))
    return at, x[at]


def _whole_sources(rows: DataFrame, keys: Sequence[str], measures: Sequence[Measure], e: Ellipsoid, schema: str) -> DataFrame:
    """The faults of sources that a task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            for m in measures:
                at, x = _values(table, m.column)
                if not len(x):
                    continue
                points = phase_points(x, m)
                for fault, bad in (("spike", spikes(points["_v"], points["_d1"], points["_d2"], e)), ("stuck", points["_stuck"])):
                    if bad.any():
                        i = pa.array(at[bad])
                        n = len(i)
                        columns = [table.column(c).take(i).combine_chunks() for c in [*keys, "_tie"]]
                        values = [pa.array(points[c][bad], pa.float64(), from_pandas=True) for c in ("_x", "_before", "_after")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([m.column] * n), pa.array([fault] * n), *values], names=names)

    names = [*keys, "_tie", "measure", "fault", "reading", "usual_before", "usual_after"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_ts", "_tie").mapInArrow(run, schema)


def _block_points(rows: DataFrame, keys: Sequence[str], measures: Sequence[Measure], block_rows: int) -> DataFrame:
    """The points of sources that no task can hold, a block at a time."""
    cell = F.explode(F.array(*[F.struct(F.lit(m.column).alias("m"), F.col(m.column).alias("x")) for m in measures])).alias("_r")
    long = rows.select(*keys, "_ts", "_tie", cell).where(F.col("_r.x").isNotNull() & ~F.isnan("_r.x")).select(*keys, F.col("_r.m").alias("_measure"), "_ts", "_tie", F.col("_r.x").alias("_x"))
    by = [*keys, "_measure"]
    halo = max(max(m.neighbours or 0, m.stuck) for m in measures) + 2
    blocks = in_blocks(with_position(long, by, "_ts", ["_tie"]), halo, block_rows=max(block_rows, 4 * halo))
    whole = [m.column for m in measures if not m.neighbours]
    middle = small_side(materialize(exact_median(long.where(F.col("_measure").isin(whole)), by, "_x"), "medians"))
    blocks = blocks.alias("b").join(middle.alias("m"), _same(by, "b", "m"), "left").select("b.*", F.col("m.median").alias("_median"))
    known = {m.column: m for m in measures}
    names = [*by, "_tie", *[c.split()[0] for c in POINT.split(", ")]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*by, "_tie").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, [*by, "_block"]):
            points = phase_points(table.column("_x").to_numpy(), known[table.column("_measure")[0].as_py()], table.column("_median")[0].as_py())
            core = np.flatnonzero(table.column("_core").to_numpy())
            columns = [table.column(c).take(pa.array(core)).combine_chunks() for c in [*by, "_tie"]]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(points[c][core], from_pandas=c != "_stuck") for c in names[len(columns) :]]], names=names)

    return blocks.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "_pos").mapInArrow(run, f"{kinds}, {POINT}")


def _deviations(left: DataFrame, by: Sequence[str], coordinates: dict[str, Column], floor: float) -> DataFrame:
    """Per source the robust standard deviation of each coordinate, over its finite values; the floor where it has none."""
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), F.abs(c))
    axis = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), finite(c).alias("z")) for k, c in coordinates.items()])).alias("_c")
    middle = exact_median(left.select(*by, axis).select(*by, F.col("_c.k").alias("_axis"), F.col("_c.z").alias("_z")), [*by, "_axis"], "_z")
    s = F.greatest(F.lit(ROBUST) * F.col("median"), F.lit(floor))
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("_axis") == k, s)).alias(f"_s{k}") for k in coordinates])


def _split_sources(points: DataFrame, keys: Sequence[str], e: Ellipsoid) -> DataFrame:
    """The spikes among points of any number, by rounds over all of them; sources in which nothing new was flagged leave the rounds."""
    by = [*keys, "_measure"]
    if not e.differences:
        points = points.withColumns({c: F.lit(None).cast("double") for c in ("_d1", "_d2")})
    left, found, done, columns = points, [points.limit(0)], 0, points.columns
    half = F.lit(math.sqrt(0.5))
    while e.rounds is None or done < e.rounds:
        n = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        scales = _deviations(left, by, {"v": F.col("_v"), "1": F.col("_d1"), "2": F.col("_d2")}, e.floor)
        axes = small_side(materialize(n.alias("n").join(scales.alias("s"), _same(by, "n", "s"), "left").select("n.*", *[F.coalesce(F.col(f"s._s{k}"), F.lit(e.floor)).alias(f"_s{k}") for k in "v12"]), "axes"))
        scaled = left.alias("p").join(axes.alias("a"), _same(by, "p", "a")).select("p.*", "a._n", (F.col("_v") / F.col("_sv")).alias("_a"), (F.col("_d1") / F.col("_s1")).alias("_b"), (F.col("_d2") / F.col("_s2")).alias("_c"))
        scaled = scaled.withColumns({"_p": (F.col("_a") + F.col("_c")) * half, "_q": (F.col("_a") - F.col("_c")) * half})
        turned = _deviations(scaled, by, {"p": F.col("_p"), "q": F.col("_q")}, e.floor)
        turned = small_side(materialize(turned, "axes"))
        one = scaled.alias("p").join(turned.alias("t"), _same(by, "p", "t"), "left").select("p.*", *[F.coalesce(F.col(f"t._s{k}"), F.lit(e.floor)).alias(f"_s{k}") for k in "pq"])
        term = lambda c, s: F.coalesce(F.pow(F.coalesce(F.col(c), F.col("_a") * half if c != "_b" else F.lit(None)) / s, F.lit(2.0)), F.lit(0.0))
        radius = term("_p", F.col("_sp")) + term("_q", F.col("_sq")) + term("_b", F.lit(1.0))
        far = (radius > 2 * F.ln(F.greatest("_n", F.lit(2)).cast("double"))) | (F.abs("_a") == F.lit(float("inf")))
        judged = materialize(one.select(*columns, F.coalesce((F.abs("_a") > F.lit(e.protect)) & far, F.lit(False)).alias("_out")), "judged")
        new = judged.where("_out").select(*columns)
        going = small_side(materialize(new.select(*by).distinct(), "going"))
        if going.isEmpty():
            break
        found.append(new)
        left = judged.where(~F.col("_out")).select(*columns).alias("p").join(going.alias("g"), _same(by, "p", "g"), "leftsemi")
        done += 1
    return reduce(DataFrame.unionByName, found)


def flag_readings(df: DataFrame, measures: Sequence[Measure], keys: Sequence[str] = ("instrument",), ts: str = "date_time", tie: str = "seq", bounds: dict[str, Column] | None = None, ellipsoid: Ellipsoid = Ellipsoid(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The readings with a fault, one row each: keys, tie, ``measure``, ``fault`` ('spike', 'stuck' or 'bounds'), ``reading``,
    ``usual_before``, ``usual_after`` (the medians that a spike was measured against) and ``rule`` (the name of the broken bound).

    Order within a source is (ts, tie). Rows with a null ts have no place and are left out; a null or NaN reading is no reading
    (its neighbours close up) and meets no bound; repeated rows count as readings; null keys form their own source; readings
    at or below 0 have no logarithm, so only their deviation counts; a reading infinitely far from the usual value is a spike.
    Sources with fewer readings than neighbours have no usual value, so they have no spikes, only runs and broken bounds. An empty
    table gives no rows. Other columns are ignored.
    """
    columns = [m.column for m in measures]
    rows = df.where(F.col(ts).isNotNull()).select(*keys, F.unix_micros(ts).alias("_ts"), F.col(tie).alias("_tie"), *[F.col(c).cast("double").alias(c) for c in columns])
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select(*keys), "large")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "_tie").schema)
    schema = f"{kinds}, measure string, fault string, reading double, usual_before double, usual_after double"
    if large.isEmpty():
        found = _whole_sources(rows, keys, measures, ellipsoid, schema)
    else:
        r, big = rows.alias("r"), small_side(large).alias("g")
        found = _whole_sources(r.join(big, _same(keys, "r", "g"), "leftanti"), keys, measures, ellipsoid, schema)
        points = materialize(_block_points(r.join(big, _same(keys, "r", "g"), "leftsemi"), keys, measures, block_rows), "points")
        named = lambda rows, fault: rows.select(*keys, "_tie", F.col("_measure").alias("measure"), F.lit(fault).alias("fault"), F.col("_x").alias("reading"), F.col("_before").alias("usual_before"), F.col("_after").alias("usual_after"))
        found = found.unionByName(named(_split_sources(points, keys, ellipsoid), "spike")).unionByName(named(points.where("_stuck"), "stuck"))
    found = found.withColumnRenamed("_tie", tie).withColumn("rule", F.lit(None).cast("string"))
    if not bounds:
        return found
    none = F.lit(None).cast("double")
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in bounds.items()]), lambda r: r.isNotNull())
    rows = df.where(F.col(ts).isNotNull()).select(*keys, F.col(tie), F.lit(None).cast("string").alias("measure"), F.lit("bounds").alias("fault"), none.alias("reading"), none.alias("usual_before"), none.alias("usual_after"), F.explode(broken).alias("rule"))
    return found.unionByName(rows)
