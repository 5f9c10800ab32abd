"""Purged and combinatorial cross-validation over label intervals (t0, t1 in epoch microseconds), per series."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.joins import asof_join
from barloom.ordering import HOUR_US, running, with_position


def _overlaps(t0: str, t1: str, start: str, end: str) -> Column:
    """The interval starts inside, ends inside or covers [start, end]."""
    a, b, s, e = F.col(t0), F.col(t1), F.col(start), F.col(end)
    return ((s <= a) & (a <= e)) | ((s <= b) & (b <= e)) | ((a <= s) & (e <= b))


def purge(train: DataFrame, tests: DataFrame, keys: Sequence[str], cell_us: float = 6 * HOUR_US) -> DataFrame:
    """The train rows (t0, t1) that overlap no test interval (start, end, in either order; not those with a null) of their series. A row overlaps one if of the tests that start by its t1 the latest end is not
    before its t0: a running maximum and one as-of look-up, whatever the number of rows and tests of a series."""
    whole = tests.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    bounds = whole.select(*keys, F.least("start", "end").alias("_s"), F.greatest("start", "end").alias("_e"))
    tops = running(bounds, keys, "_s", ["_e"], {"_top": ("max", "_e")}, cell_us=cell_us)
    found = asof_join(train, tops, keys, "t1", "_s", ["_top"], cell_us=cell_us)
    return found.where(~F.coalesce(F.col("_top") >= F.col("t0"), F.lit(False))).drop("_top")


def with_folds(labels: DataFrame, keys: Sequence[str], n_splits: int, cell_us: float = 6 * HOUR_US) -> DataFrame:
    """labels with ``pos`` (rank by t0, t1), ``n`` and ``fold``: contiguous folds, the first n mod n_splits one longer."""
    rows = with_position(labels, keys, "t0", ["t1"], cell_us, out="pos")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, list(keys))
    size, extra = F.expr(f"n div {n_splits}"), F.expr(f"n % {n_splits}")
    long = extra * (size + 1)
    fold = F.when(F.col("pos") < long, F.floor(F.col("pos") / (size + 1))).otherwise(extra + F.floor((F.col("pos") - long) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int"))


def fold_spans(folded: DataFrame, keys: Sequence[str], embargo: float = 0.0, strict: bool = False) -> DataFrame:
    """keys, fold, ``start`` and ``end`` of each fold's test interval. It starts at t1 of the fold's first row (``strict``: at its t0) and ends at t1 of the row
    that lies the embargo, a share of all rows, behind its last one."""
    ends = folded.groupBy(*keys, "fold", "n").agg(F.min(F.struct("pos", "t0", "t1")).alias("a"), F.max("pos").alias("b"))
    ends = ends.withColumn("_last", F.when(F.col("b") + 1 < F.col("n"), F.least(F.col("b") + F.floor(F.col("n") * F.lit(embargo)), F.col("n") - 1)).otherwise(F.col("b")))
    l, r = ends.alias("e"), folded.alias("f")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return l.join(r, [*same, F.col("e._last") == F.col("f.pos")]).select(*[F.col(f"e.{k}") for k in keys], F.col("e.fold"), F.col("e.a")["t0" if strict else "t1"].alias("start"), F.col("f.t1").alias("end"))


def purged_folds(labels: DataFrame, keys: Sequence[str], n_splits: int = 3, embargo: float = 0.0, strict: bool = False, cell_us: float = 6 * HOUR_US) -> DataFrame:
    """One row per split and label that is in it: keys, ``split``, t0, t1 and ``role`` ('test' or 'train'). Train labels are those that overlap neither the
    test interval nor its embargo."""
    folded = with_folds(labels, keys, n_splits, cell_us)
    spans = fold_spans(folded, keys, embargo, strict)
    l, r = folded.alias("l"), spans.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    pairs = l.join(r, same).withColumn("role", F.when(F.col("l.fold") == F.col("r.fold"), "test").when(~_overlaps("l.t0", "l.t1", "r.start", "r.end"), "train"))
    return pairs.where(F.col("role").isNotNull()).select(*[F.col(f"l.{k}") for k in keys], F.col("r.fold").alias("split"), F.col("l.t0"), F.col("l.t1"), "role")


def backtest_paths(n_splits: int, n_test: int) -> int:
    return comb(n_splits, n_splits - n_test) * n_test // n_splits


def combinatorial_folds(labels: DataFrame, keys: Sequence[str], n_splits: int = 4, n_test: int = 2, embargo: float = 0.0) -> DataFrame:
    """Combinatorial purged folds: keys, ``split`` (number of the combination), ``tests`` (its folds), t0, t1 and ``role``. A train label overlaps none of
    the test intervals."""
    folded = with_folds(labels, keys, n_splits)
    spans = fold_spans(folded, keys, embargo)
    tests = F.array(*[F.struct(F.lit(i).alias("split"), F.array(*[F.lit(x) for x in c]).alias("tests")) for i, c in enumerate(combinations(range(n_splits), n_test))])
    by_series = spans.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("start", "end")))).alias("_spans"))
    rows = folded.join(by_series, list(keys)).withColumn("_s", F.explode(tests)).select(*keys, "t0", "t1", "fold", "_spans", F.col("_s.split").alias("split"), F.col("_s.tests").alias("tests"))

    def hit(i: Column) -> Column:
        x = F.try_element_at(F.col("_spans"), i)
        a, b = F.col("t0"), F.col("t1")
        return F.coalesce(((x["start"] <= a) & (a <= x["end"])) | ((x["start"] <= b) & (b <= x["end"])) | ((a <= x["start"]) & (x["end"] <= b)), F.lit(False))

    role = F.when(F.array_contains("tests", F.col("fold")), "test").when(~F.exists("tests", hit), "train")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).select(*keys, "split", "tests", "t0", "t1", "role")


def path_assignment(n_splits: int, n_test: int) -> list[tuple[int, int, int]]:
    """(path, fold, split): which combination tests which fold on which backtest path."""
    used = [0] * n_splits
    out = []
    for split, folds in enumerate(combinations(range(n_splits), n_test)):
        for f in folds:
            out.append((used[f], f, split))
            used[f] += 1
    return sorted(out)
