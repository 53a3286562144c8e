"""Cross-provider reconciliation of price history and single-bar checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import is_weekend


def by_day(raw: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Resolve every (ticker, d) of raw (provider, ticker, d, close).

    Weekend days are dropped. With two or more providers, at least two must lie within the tolerance
    of the median, and the median of those is the consensus; otherwise the day is a conflict. A single
    provider is kept uncorroborated. The quotes of one day are at most one per provider, so the small
    array per day is bounded.
    """
    valid = raw.where(F.col("close").isNotNull() & ~F.isnan("close") & (F.col("close") > 0))
    one = valid.groupBy("ticker", "d", "provider").agg(F.max("close").alias("close"))
    day = one.groupBy("ticker", "d").agg(
        F.count("*").alias("n"), F.median("close").alias("_m"),
        F.array_sort(F.collect_list("close")).alias("_closes"), F.min("provider").alias("_provider"))
    agree = F.filter("_closes", lambda c: F.abs(c / F.col("_m") - 1) <= tolerance)
    k = F.size("_agree")
    middle = F.when(
        k % 2 == 1, F.try_element_at("_agree", ((k + 1) / 2).cast("int"))
    ).otherwise((F.try_element_at("_agree", F.greatest((k / 2).cast("int"), F.lit(1)))
                 + F.try_element_at("_agree", (k / 2 + 1).cast("int"))) / 2)
    status = (F.when(is_weekend("d"), "weekend").when(F.col("n") == 1, "single")
              .when(k >= 2, "consensus").otherwise("conflict"))
    return day.withColumn("_agree", agree).select(
        "ticker", "d", status.alias("status"),
        F.when(F.col("n") == 1, F.element_at("_closes", 1)).when(k >= 2, middle).alias("close"),
        F.when(F.col("n") == 1, F.col("_provider")).when(k >= 2, F.lit("consensus")).alias("source"))


def flag_spikes(days: DataFrame, jump: float = 0.5) -> DataFrame:
    """Add `spike` to resolved days (ticker, d, status, close).

    A bar is a spike when it is uncorroborated, jumps more than `jump` from the last kept bar and the
    next bar is back within `jump` of it. Within a run of bars that each look like a spike against
    their neighbours, dropping one makes the next the reference again, so the odd positions go.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    prev, nxt = F.lag("close").over(w), F.lead("close").over(w)
    looks = F.coalesce(
        (F.col("status") == "single") & (F.abs(F.col("close") / prev - 1) > jump)
        & (F.abs(nxt / prev - 1) <= jump), F.lit(False))
    calm = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return (
        days.withColumn("_looks", looks).withColumn("_i", F.row_number().over(w))
        .withColumn("_calm", F.max(F.when(~F.col("_looks"), F.col("_i"))).over(calm))
        .withColumn("spike", F.col("_looks") & ((F.col("_i") - F.coalesce("_calm", F.lit(0))) % 2 == 1))
        .drop("_looks", "_i", "_calm")
    )


def reconcile(raw: DataFrame, tolerance: float = 0.02, jump: float = 0.5) -> DataFrame:
    """Kept rows (ticker, d, close, source, corroborated)."""
    days = by_day(raw, tolerance).where(F.col("status").isin("single", "consensus"))
    return flag_spikes(days, jump).where(~F.col("spike")).select(
        "ticker", "d", "close", "source", (F.col("status") == "consensus").alias("corroborated"))


def reconcile_stats(raw: DataFrame, tolerance: float = 0.02, jump: float = 0.5) -> DataFrame:
    """Kept and dropped days per ticker."""
    days = by_day(raw, tolerance)
    usable = flag_spikes(days.where(F.col("status").isin("single", "consensus")), jump)
    dropped = days.where(~F.col("status").isin("single", "consensus")).withColumn("spike", F.lit(False))
    every = usable.unionByName(dropped)
    status, spike = F.col("status"), F.col("spike")
    return every.groupBy("ticker").agg(
        F.count_if(status.isin("single", "consensus") & ~spike).alias("kept"),
        F.count_if(status == "weekend").alias("dropped_weekend"),
        F.count_if(status == "conflict").alias("dropped_conflict"),
        F.count_if(spike).alias("dropped_jump"),
        F.count_if((status == "single") & ~spike).alias("single_source"),
        F.count_if(status == "consensus").alias("corroborated"))


def plausible_next(price: Column, prev: Column, max_ratio: float = 5.0) -> Column:
    """A finite positive price no more than `max_ratio` away from a usable previous close."""
    good = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < F.lit(float("inf")))
    usable = F.coalesce((prev > 0) & ~F.isnan(prev), F.lit(False))
    r = price / F.when(usable, prev)
    return good & (~usable | F.coalesce((r <= max_ratio) & (r >= 1 / max_ratio), F.lit(False)))


def flag_implausible(bars: DataFrame, max_ratio: float = 5.0) -> DataFrame:
    prev = F.lag("close").over(Window.partitionBy("ticker").orderBy("d"))
    return bars.withColumn("plausible", plausible_next(F.col("close"), prev, max_ratio))
