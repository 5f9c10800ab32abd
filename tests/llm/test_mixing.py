import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.mixing import Mix, fit, knapsack

DOCS, TARGETS = "doc_id long, source string, text string, n_tokens int, copies int", "source string, target_share double, max_repeats int, n long"


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3)), max_size=4, unique_by=lambda x: x[0]), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_knapsack_is_optimal(items, budget):
    lengths, counts = [n for n, _ in items], [c for _, c in items]
    take = knapsack(lengths, counts, budget)
    used = sum(int(t) * n for t, n in zip(take, lengths))
    best = max(s for s in (sum(k * n for k, n in zip(ks, lengths)) for ks in itertools.product(*[range(c + 1) for c in counts])) if s <= budget)
    assert used == best and all(0 <= t <= c for t, c in zip(take, counts))


@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.floats(0, 3), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_fit_stays_in_the_budget(items, share, most):
    lengths, counts = np.array([n for n, _ in items]), np.array([c for _, c in items])
    total = int((lengths * counts).sum())
    budget = int(share * total)
    repeats, take = fit(lengths, counts, budget, most)
    used = repeats * total + int((lengths * take).sum())
    assert (take >= 0).all() and (take <= counts).all() and repeats <= most and (repeats < most or not take.any())
    assert used <= budget or total * most <= budget or total == 0


def test_exact_when_lengths_allow():
    repeats, take = fit(np.array([1, 7, 300]), np.array([500, 400, 900]), 123_457, 1)
    assert repeats == 0 and int((np.array([1, 7, 300]) * take).sum()) == 123_457


def best_of(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


def test_the_even_share_is_given_up_for_a_better_sum():
    lengths, counts = np.array([3167, 27478]), np.array([4, 1])
    repeats, take = fit(lengths, counts, 31149, 1)
    assert repeats == 0 and 31149 - int((lengths * take).sum()) == 504


@given(st.lists(st.tuples(st.integers(0, 90), st.integers(1, 6)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.floats(0, 0.999))
@settings(max_examples=200, deadline=None)
def test_fit_is_the_best_sum(items, share):
    lengths, counts = np.array([n for n, _ in items]), np.array([c for _, c in items])
    budget = int(share * int((lengths * counts).sum()))
    repeats, take = fit(lengths, counts, budget, 1)
    if (lengths * counts).sum():
        assert repeats == 0 and int((lengths * take).sum()) == best_of(lengths.tolist(), counts.tolist(), budget)


def test_fit_of_many_documents():
    """Millions of documents of a thousand lengths, and of two lengths: met to the token."""
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(np.arange(20, 30_000), 1000, replace=False))
    counts = rng.integers(1, 20_000, 1000)
    for n, c, share in ((lengths, counts, 0.37), (np.array([3167, 27478]), np.array([4_000_000, 1_000_000]), 0.41)):
        budget = int(share * int((n * c).sum()))
        repeats, take = fit(n, c, budget, 1)
        assert repeats == 0 and int((n * take).sum()) == budget and (take <= c).all() and (take >= 0).all()


def make(spark, seed=0):
    rng = random.Random(seed)
    rows = []
    for d in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", None, "other"])
        rows.append((d, source, rng.choice([None, "", "word " * rng.randrange(1, 60), "same text here"]), 0, 0))
    targets = [("a", 0.2, 1, 0), ("b", 0.3, 3, 0), ("c", 0.4, 1, 0), ("none", 0.1, 5, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)


def test_mix_reaches_shares_and_reports(spark):
    docs, targets = make(spark)
    mix = Mix(docs, targets)
    report = {r.source: r for r in mix.report().collect()}
    rows = mix.selection().collect()
    assert set(report) == {"a", "b", "c", "none"} and report["none"].short and report["none"].selected_tokens == 0
    for s, most in (("a", 1), ("b", 3), ("c", 1)):
        mine = [r for r in rows if r.source == s]
        used = sum(r.n_tokens * r.copies for r in mine)
        assert used == report[s].selected_tokens and all(1 <= r.copies <= most for r in mine)
        assert len({r.doc_id for r in mine}) == len(mine)
        r = report[s]
        assert r.short == (r.available_tokens * most < r.target_share * mix.total)
        if r.short:
            assert used == r.available_tokens * most
        else:
            assert r.target_tokens - 1 <= used <= r.target_tokens
    again = sorted(map(str, Mix(docs, targets).selection().collect()))
    assert again == sorted(map(str, rows))
    assert sorted(map(str, Mix(docs, targets, seed=5).selection().collect())) != again


def test_one_length_holds_all(spark):
    """All documents are alike: the cut runs through one (source, length)."""
    docs = spark.createDataFrame([(d, "a" if d % 3 else "b", "the same words in all", 0, 0) for d in range(3000)], DOCS)
    mix = Mix(docs, spark.createDataFrame([("a", 0.5, 1, 0)], TARGETS))
    n = mix.selection().count()
    r = mix.report().first()
    assert n * mix.selection().first().n_tokens == r.selected_tokens and n == 1500


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 0.5, None, 0), ("b", None, 1, 0)], TARGETS)
    mix = Mix(docs, targets)
    assert mix.selection().count() == 0 and {r.source: r.short for r in mix.report().collect()} == {"a": False, "b": False}
    docs = spark.createDataFrame([(1, "x", "some text", 0, 0)], DOCS)
    assert {r.source for r in Mix(docs, targets).report().where("short").collect()} == {"a"}
