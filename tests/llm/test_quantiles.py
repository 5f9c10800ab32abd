import math
import random

import pytest

from barloom.llm.quantiles import combine, percentiles, summarize

SCHEMA = "g long, a double, b double, field string, value double, n long"


def brute(xs, q):
    xs = sorted(xs)
    return xs[max(math.ceil(q * len(xs) - 1e-9), 1) - 1]


def rows_of(seed, n=3000):
    rng = random.Random(seed)
    special = [None, float("nan"), float("inf"), -float("inf"), 7.0, -0.0]
    # Group 1 holds most rows.
    return [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(special) if rng.random() < 0.1 else round(rng.random(), rng.choice([2, 6])), rng.gauss(0, 1), "x", 0.0, 0) for _ in range(n)]


def test_percentiles_match_brute_force(spark):
    rows = rows_of(1)
    s = summarize(spark.createDataFrame(rows, SCHEMA), ["g"], {"a": (0.0, 1.0), "b": None})
    qs = [0, 0.01, 0.5, 0.95, 1]
    got = {(r.g, r.field, r.probability): (r.value, r.total) for r in percentiles(s, ["g"], qs, partitions=7).collect()}
    want = {}
    for g, a, b, *_ in rows:
        if a is not None and a == a and 0 <= a <= 1:
            want.setdefault((g, "a"), []).append(a + 0.0)
        want.setdefault((g, "b"), []).append(b)
    assert got == {(g, f, q): (brute(xs, q), len(xs)) for (g, f), xs in want.items() for q in qs}


def test_summaries_combine(spark):
    one, two = rows_of(2, 500), rows_of(3, 700)
    make = lambda r: summarize(spark.createDataFrame(r, SCHEMA), ["g"], {"b": None})
    key = lambda df: sorted(map(str, df.collect()))
    assert key(percentiles(combine(make(one), make(two)), ["g"], [0.3])) == key(percentiles(make(one + two), ["g"], [0.3]))


def test_resolution_bounds_the_error(spark):
    df = spark.createDataFrame(rows_of(4), SCHEMA)
    exact = {r.g: r.value for r in percentiles(summarize(df, ["g"], {"b": None}), ["g"], [0.5]).collect()}
    rough = summarize(df, ["g"], {"b": None}, resolution=0.1)
    assert rough.count() < 400
    assert all(abs(r.value - exact[r.g]) <= 0.1 + 1e-9 for r in percentiles(rough, ["g"], [0.5]).collect())


def test_ties_empty_and_arguments(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, "x", 0.0, 0)] * 9 + [(2, None, None, "x", 0.0, 0)], SCHEMA)
    out = percentiles(summarize(df, ["g"], {"a": None, "b": None}), ["g"], [0.1, 0.9]).collect()
    assert len(out) == 4 and {r.total for r in out} == {9}
    empty = summarize(spark.createDataFrame([], SCHEMA), ["g"], {"a": None})
    assert percentiles(empty, ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        percentiles(empty, ["g"], [2])
