"""Mixing sources to target weights, in tokens.

Method: subset-sum budget fitting. Documents are counted by (source, exact token length); per source the budget is met by whole
repeats of everything, and what remains of it by the best choice of documents drawn once more: a bounded knapsack over the
counts of lengths. It starts from an even share of each length, and a dynamic program fits the rest of the budget. Where
that leaves tokens, documents of the even share are freed and fitted again, more each time, until the budget is met to the
token, or nothing better exists: a best choice differs from the even share by at most (gap + 2 x longest) documents of a
length, because the steps from one to the other can be ordered so that their sums stay in a window of that size, and
steps between two equal sums cancel. Documents are then selected per (source, length) by a seeded hash, as many as the fit asks
for.

Scale: a source's lengths are bounded by the longest text, not by its documents, so each source is fitted from one small group, and
the dynamic program runs over the rest of the budget and the freed documents, not over the budget. The seeded order inside one
(source, length) is cut in hash buckets, and only the bucket on the cut is ranked row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.tokens import VOCABULARY, token_counts
from barloom.shared import materialize, small_side

BUCKETS = 1024


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> np.ndarray:
    """How many of each length, at most its count, so that their sum is the largest possible up to ``budget``. Reachable sums are
    the bits of one integer; pieces of 1, 2, 4 ... of a length keep the count's bound. Of each sum the first step that reaches
    it is kept, so going back through the steps needs one number a sum."""
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    reach, mask, steps, size = 1, (1 << (budget + 1)) - 1, [], budget // 8 + 1
    first = np.full(size * 8, -1, dtype=np.int32)
    left = [min(int(c), budget // int(n)) if n else 0 for n, c in zip(lengths, counts)]
    piece = 1
    while any(left) and not reach >> budget & 1:  # one of each length before two of any
        for i, n in enumerate(lengths):
            if not left[i]:
                continue
            k = min(piece, left[i])
            left[i] -= k
            new = (reach << (k * int(n))) & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(size, "little"), dtype=np.uint8)
                some = np.flatnonzero(bits)
                which, bit = np.nonzero(np.unpackbits(bits[some][:, None], axis=1, bitorder="little"))
                first[some[which] * 8 + bit] = len(steps)
                steps.append((i, k))
                reach |= new
                if new >> budget & 1:
                    break
        piece *= 2
    at = reach.bit_length() - 1
    while at:
        i, k = steps[first[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int, seed: int = 0) -> tuple[int, np.ndarray]:
    """Whole repeats of every document, and how many documents of each length once more. Their tokens are the most that stay within the
    budget; of equally good choices one near the even share of each length is taken."""
    total = int((lengths * counts).sum())
    if total == 0 or total * max_repeats <= budget:
        return max_repeats, np.zeros(len(lengths), dtype=np.int64)
    repeats = budget // total
    whole = budget - repeats * total
    goal = whole - whole % int(np.gcd.reduce(lengths[lengths > 0]))  # no sum of lengths lies between
    even = counts * (goal / total)
    take = np.minimum(np.floor(even).astype(np.int64), counts)
    order = np.random.default_rng(seed).permutation(len(lengths))
    order = order[np.argsort(-(even % 1.0)[order], kind="stable")]
    longest, rest = int(lengths.max()), goal - int((take * lengths).sum())
    while rest < 0:  # the share's rounding
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        rest += int(lengths[i])
    for i in order:  # by largest remainder, while the rest is far from what single documents hold
        if rest > 4 * longest and take[i] < counts[i] and lengths[i]:
            take[i] += 1
            rest -= int(lengths[i])
    free, enough = 0, rest + 2 * longest
    while True:
        kept = np.maximum(take - free, 0)
        room = goal - int((kept * lengths).sum())
        more = np.zeros(len(lengths), dtype=np.int64)
        more[order] = knapsack(lengths[order], (counts - kept)[order], room)
        if int((more * lengths).sum()) == room or free >= enough or not kept.any():
            return int(repeats), kept + more
        free = max(1, 2 * free)


def _plan(tokens: DataFrame, targets: DataFrame, source: str, total: int, seed: int) -> DataFrame:
    """source, n_tokens, ``n`` documents, ``repeats`` of each and ``take`` of them once more, for every source of ``targets`` (one row
    with n = 0 where it has no documents). ``short``: all was drawn and does not make up the share."""
    counts = tokens.where(F.col(source).isNotNull()).groupBy(source, "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    t = small_side(targets.select(F.col(source), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")))
    rows = t.join(counts, source, "left").select(F.col(source).alias("_source"), "share", "most", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n", F.lit(0)).alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens").reset_index(drop=True)
        budget, most = int(np.floor(float(pdf.share.iloc[0]) * total)), int(pdf.most.iloc[0])
        lengths, counts = pdf.n_tokens.to_numpy(np.int64), pdf.n.to_numpy(np.int64)
        repeats, take = fit(lengths, counts, budget, most, seed=seed)
        available = int((lengths * counts).sum())
        used = repeats * available + int((lengths * take).sum())
        return pd.DataFrame({"_source": pdf._source, "n_tokens": lengths, "n": counts, "repeats": repeats, "take": take, "available": available, "used": used, "short": repeats == most and used < float(pdf.share.iloc[0]) * total})

    kind = targets.select(source).schema[0].dataType.simpleString()
    return rows.groupBy("_source").applyInPandas(solve, f"_source {kind}, n_tokens bigint, n bigint, repeats bigint, take bigint, available bigint, used bigint, short boolean")


class Mix:
    """Documents drawn so that each source of ``targets`` (source, target_share, max_repeats) has its share of the total tokens.

    The total is the size of all documents with a non-null source, each once. A source that can't reach its share contributes
    every document max_repeats times. Null texts and null targets count as 0, a null max_repeats as 1; documents of other or null sources are
    not drawn; repeated document rows are separate documents; empty tables give no selection, and a report of shortfalls.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY, seed: int = 0):
        self.doc_id, self.source, self.seed, self.targets = doc_id, source, seed, targets
        self.tokens = materialize(token_counts(docs, [doc_id, source], text, vocabulary), "tokens")
        self.total = self.tokens.where(F.col(source).isNotNull()).agg(F.sum("n_tokens")).first()[0] or 0
        self.plan = materialize(_plan(self.tokens, targets, source, self.total, seed), "plan")

    def report(self) -> DataFrame:
        """source, target_share, ``target_tokens``, ``available_tokens``, ``selected_tokens``, ``reached_share`` (of the total), ``mix_share``
        (of what was selected) and ``short`` (every document was drawn max_repeats times, and the tokens drawn are below the share)."""
        one = self.plan.groupBy(F.col("_source").alias(self.source)).agg(F.max("available").alias("available_tokens"), F.max("used").alias("selected_tokens"), F.max("short").alias("short"))
        rows = self.targets.select(self.source, "target_share").join(one, self.source)
        everything = self.plan.select("_source", "used").distinct().agg(F.sum("used")).first()[0] or 0
        share = lambda of: F.try_divide(F.col("selected_tokens").cast("double"), F.lit(float(of)))
        return rows.select(self.source, "target_share", F.floor(F.coalesce("target_share", F.lit(0.0)) * F.lit(float(self.total))).alias("target_tokens"), "available_tokens", "selected_tokens", share(self.total).alias("reached_share"), share(everything).alias("mix_share"), "short")

    def selection(self) -> DataFrame:
        """doc_id, source, ``n_tokens`` and ``copies`` of each document drawn at least once."""
        by = [self.source, "n_tokens"]
        h = F.xxhash64(F.lit(self.seed), F.col(self.doc_id))
        docs = self.tokens.withColumn("_h", h).withColumn("_bucket", F.pmod(F.shiftright("_h", 40), F.lit(BUCKETS)))
        plan = small_side(self.plan.select(F.col("_source").alias(self.source), "n_tokens", "repeats", "take", F.col("n").alias("_n")))
        docs = docs.join(plan, by)
        partial = (F.col("take") > 0) & (F.col("take") < F.col("_n"))
        whole = docs.where(~partial).withColumn("copies", F.col("repeats") + F.when(F.col("take") > 0, 1).otherwise(0))
        part = docs.where(partial)
        buckets = part.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_k"))
        before = F.sum("_k").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        part = part.join(buckets.select(*by, "_bucket", "_k", F.coalesce(before, F.lit(0)).alias("_before")), [*by, "_bucket"])
        clear = (F.col("_before") + F.col("_k") <= F.col("take")) | (F.col("_before") >= F.col("take"))
        sure = part.where(clear).withColumn("copies", F.col("repeats") + F.when(F.col("_before") < F.col("take"), 1).otherwise(0))
        rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_h", self.doc_id))
        edge = part.where(~clear).withColumn("_rank", rank).withColumn("copies", F.col("repeats") + F.when(F.col("_before") + F.col("_rank") <= F.col("take"), 1).otherwise(0))
        columns = [self.doc_id, self.source, "n_tokens", "copies"]
        return whole.select(*columns).unionByName(sure.select(*columns)).unionByName(edge.select(*columns)).where(F.col("copies") > 0)
