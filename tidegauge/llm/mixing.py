"""Mixing sources to target weights by fitting each source's budget as a subset sum.

Sources share a budget by weight, none above a multiple of its own size. Within a source, documents are
counted by exact length. Whole passes over the source come first; of the remaining budget each length
gives its proportional number of documents, the rest is fitted by a bounded-knapsack dynamic program
over the length counts, and the documents of a length are chosen in seeded order. While the budget is
not met exactly, documents are put back and the program runs over more words, at last over the whole
budget, so no choice of documents comes nearer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACE
from tidegauge.session import cut

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Words that the dynamic program covers at first, and hash buckets of a length.
FIT, BUCKETS = 1 << 14, 256


def words(text: Column) -> Column:
    """Number of words of a text, null and empty 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Sources by code point, null last, weigh
    `weights` in turn and share `share` of all sizes; a target stops at `most` times its source's size and
    the excess is shared anew by weight among the others. The sources may be many: they are ranked by a
    distributed sort, and each sharing round is one aggregate."""
    kind = totals.schema["source"].dataType
    ordered = totals.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex() \
        .map(lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    ranked = cut(totals.sparkSession.createDataFrame(ordered, f"source {kind.simpleString()}, source_size long, rank long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    size = F.col("source_size")
    budget, level = None, 0.0
    while True:
        full = weight * level > most * size if budget is not None else F.lit(False)
        open_, used, total = ranked.agg(F.sum(F.when(~full, weight)), F.sum(F.when(full, most * size)), F.sum(size)).collect()[0]
        budget = share * (total or 0)
        new = (budget - (used or 0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.lit(float(most)) * size, weight * level).alias("target"))


def extended(reach: int, parts: list[tuple[int, int]], limit: int) -> int:
    """Sums up to the limit as bits: those of `reach` with or without each part's words."""
    full = (1 << limit + 1) - 1
    reach &= full
    for _, words_ in parts:
        reach |= reach << words_ & full
    return reach


def chosen(parts: list[tuple[int, int]], before: int, at: int) -> list[int]:
    """Places of the parts that lead from a sum in `before` to the sum `at`. Halves are run again instead of
    keeping the sums of each step: as many bit sets are held as the parts can be halved."""
    found, open_ = [], [(0, len(parts), before)]
    while open_:
        low, high, before = open_.pop()
        if before >> at & 1:
            continue
        if high - low == 1:
            found.append(low)
            at -= parts[low][1]
            continue
        half = (low + high) // 2
        open_ += [(low, half, before), (half, high, extended(before, parts[low:half], at))]
    return found


def nearest(lengths: np.ndarray, available: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that no other choice comes nearer to the budget from below."""
    take, parts, counts, reach = np.zeros(len(lengths), np.int64), [], [], 1
    for i in np.argsort(lengths)[::-1]:
        size = int(lengths[i])
        n, part = min(int(available[i]), budget // size), 1
        while n > 0 and not reach >> budget & 1:
            part = min(part, n)
            parts.append((i, part * size))
            counts.append(part)
            reach = extended(reach, parts[-1:], budget)
            n, part = n - part, part * 2
    for k in chosen(parts, 1, reach.bit_length() - 1):
        take[parts[k][0]] += counts[k]
    return take


def fit(lengths: np.ndarray, available: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum comes nearest below the budget: proportional
    counts, rounded over the lengths in order, and the longest that fit; then the dynamic program over the
    rest and documents put back, four times as many words each time, until the budget is met or all are
    put back. Lengths count in units of their greatest common divisor."""
    unit = math.gcd(*map(int, lengths))
    lengths, budget = lengths // unit, budget // unit
    total = int((lengths * available).sum())
    if budget >= total:
        return available.copy()
    order, take, seen = np.argsort(-lengths), np.zeros(len(lengths), np.int64), 0
    for i in order:  # from the longest on, so that the rounded counts stay below the budget
        take[i] = (seen + int(available[i])) * budget // total - seen * budget // total
        seen += int(available[i])
    left = budget - int((lengths * take).sum())
    for i in order:
        if left <= FIT:
            break
        more = min(int(available[i] - take[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    window = FIT
    while True:
        for i in order:
            back = min(int(take[i]), max(0, -((left - window) // int(lengths[i]))))
            take[i] -= back
            left += back * int(lengths[i])
        more = nearest(lengths, available - take, left)
        if int((lengths * more).sum()) == left or not take.any():
            return take + more
        window = 4 * max(window, left)


def plan(sized: DataFrame, wanted: DataFrame, source: str, size: str) -> DataFrame:
    """(source, size, n, passes, take) for each source and length: whole passes over the source, and how
    many documents of the length are taken once more. One group is a source's distinct lengths, not its
    documents."""
    histogram = sized.where(F.col(size) > 0).groupBy(F.col(source).alias("source"), F.col(size).alias("size")) \
        .agg(F.count(F.lit(1)).alias("n"))
    joined = histogram.join(wanted, histogram["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    kind = joined.schema["source"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        whole, goal = int(group["source_size"].iloc[0]), int(round(group["target"].iloc[0]))
        passes = goal // whole
        take = fit(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), goal - passes * whole)
        return group[["source", "size", "n"]].assign(passes=passes, take=take)

    return joined.groupBy("source").applyInPandas(solve, f"source {kind}, size long, n long, passes long, take long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
        weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target (its source's) and `taken`, the
    words that the mix takes of it, repeats counted: 0, 1 or 2 times its size. Null texts have size 0, a
    null source is a source, rows of equal id and length are interchangeable, extra columns are left
    behind, and an empty table gives an empty result. Within a length, documents go by a seeded hash of
    the id: whole hash buckets are settled by counts, and only the bucket in which the number is reached
    is ranked, so one length may hold any part of all rows."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(docs[text]).alias("size"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    sized = cut(plain.withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 56)))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = cut(targets(totals, weights, share, most))
    planned = cut(plan(sized, wanted, "source", "size"))

    cell = ["source", "size"]
    run = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = sized.where("size > 0").groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("in_bucket")) \
        .withColumn("up_to", F.sum("in_bucket").over(run))  # at most BUCKETS rows a source and length
    p = planned.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "passes", "take")
    decided = cut(buckets.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).select(
        F.col("source").alias("d_source"), F.col("size").alias("d_size"), F.col("bucket").alias("d_bucket"), "passes",
        F.greatest(F.lit(0), F.least("in_bucket", F.col("take") - F.col("up_to") + F.col("in_bucket"))).alias("quota"), "in_bucket"))
    with_quota = sized.join(decided, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("size") == F.col("d_size"))
                            & (F.col("bucket") == F.col("d_bucket")), "left")
    part = (F.col("quota") > 0) & (F.col("quota") < F.col("in_bucket"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id"))
    ranked = with_quota.where(part).withColumn("once_more", (rank <= F.col("quota")).cast("long"))
    settled = with_quota.where(~F.coalesce(part, F.lit(False))) \
        .withColumn("once_more", F.coalesce((F.col("quota") > 0).cast("long"), F.lit(0)))
    both = ranked.unionByName(settled)
    w = wanted.select(F.col("source").alias("w_source"), "source_size", "target")
    return both.join(w, F.col("source").eqNullSafe(F.col("w_source"))).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.coalesce("passes", F.lit(0)) + F.col("once_more"))).alias("taken"))
