"""Quote corroboration, integrity flags and series health."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import ratio, upper_middle, with_group

BAD_DATA = "divergence|jump|consensus"


def corroborate(prices: DataFrame, key: str = "ticker", divergence: float = 0.03,
                rank: str = "source_rank") -> DataFrame:
    """Cross-check prices (key, source, price, source_rank) of each key.

    `used` is the mean of the prices within `divergence` of the median; when none is, it is the print
    of the best-ranked source, never an invented midpoint. `ok` is null with a single source.
    """
    valid = prices.where((F.col("price") > 0) & ~F.isnan("price"))
    marked = with_group(valid, [key], median=F.median("price"))
    near = F.abs(F.col("price") / F.col("median") - 1) <= divergence
    out = marked.groupBy(key).agg(
        F.count("*").alias("n"), F.max("median").alias("median"),
        ((F.max("price") - F.min("price")) / F.max("median")).alias("spread"),
        F.coalesce(F.avg(F.when(near, F.col("price"))), F.min_by("price", rank)).alias("used"),
        F.min_by("source", rank).alias("primary_source"),
        F.min_by("price", rank).alias("primary_price"))
    return out.withColumn("ok", F.when(F.col("n") >= 2, F.col("spread") <= divergence))


def integrity(quotes: DataFrame, as_of: Column, divergence: float = 0.03, stale_days: int = 6,
              jump: float = 0.35) -> DataFrame:
    """Publishable price and flags.

    Needs price, as_of, prev_price and the corroboration columns (ok, used, n, primary_source). When
    the sources diverge and the published price is itself the outlier, the consensus replaces it.
    """
    price = F.col("price")
    diverged = F.coalesce(~F.col("ok"), F.lit(False))
    swap = diverged & (F.abs(price / F.col("used") - 1) > divergence)
    final = F.when(swap, F.col("used")).otherwise(price)
    age = F.datediff(as_of, F.col("as_of"))
    moved = F.abs(ratio(final, F.col("prev_price")) - 1)
    flags = F.array_compact(F.array(
        F.when(diverged, F.lit("source divergence")),
        F.when(swap, F.lit("price moved to consensus")),
        F.when(F.col("ok").isNull(), F.concat(F.lit("single-source "), F.col("primary_source"))),
        F.when(F.col("as_of").isNull(), F.lit("freshness unknown")),
        F.when(age > stale_days, F.lit("stale last bar")),
        F.when(moved > jump, F.lit("jump vs last scan"))))
    return quotes.withColumns({"price": final, "flags": flags})


def has_bad_data(flags: Column) -> Column:
    return F.exists(flags, lambda f: f.rlike(BAD_DATA))


def gate_counts() -> list[Column]:
    is_ok = F.col("error").isNull()
    checked = is_ok & F.col("n").isNotNull()
    return [
        F.count("*").alias("total"),
        F.count_if(is_ok).alias("ok_quotes"),
        F.count_if(~is_ok).alias("errored"),
        F.count_if(is_ok & (F.size("flags") > 0)).alias("flagged"),
        F.count_if(is_ok & has_bad_data(F.col("flags"))).alias("bad_data"),
        F.count_if(checked & F.col("ok").isNull()).alias("uncorroborated"),
        F.count_if(checked & F.coalesce("ok", F.lit(False))).alias("corroborated"),
        F.count_if(checked).alias("corroborated_of")]


def observed(quotes: DataFrame) -> tuple[DataFrame, Observation]:
    """The quotes, and what the gate needs to know of them, counted by whichever action writes them."""
    seen = Observation(f"gate-{uuid.uuid4().hex}")
    return quotes.observe(seen, *gate_counts()), seen


def gate_of(spark: SparkSession, seen: Observation) -> DataFrame:
    """The gate after the observed quotes were written; no second scan."""
    counts = seen.get
    return judged(spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts)))


def quality_gate(quotes: DataFrame) -> DataFrame:
    """One row: is this scan good enough to fire triggers? Needs error, flags, ok and n."""
    return judged(quotes.agg(*gate_counts()))


def judged(counts: DataFrame) -> DataFrame:
    error_rate = F.coalesce(ratio("errored", "total"), F.lit(1.0))
    bad_rate = F.coalesce(ratio("bad_data", "ok_quotes"), F.lit(0.0))
    cover = F.coalesce(ratio("corroborated", "corroborated_of"), F.lit(0.0))
    degraded = (error_rate > 0.3) | (bad_rate > 0.25) | ((F.col("corroborated_of") >= 3) & (cover < 0.5))
    return counts.withColumn("degraded", degraded)


def daily_frequency(bars: DataFrame, min_bars: int = 10, max_gap: int = 4) -> DataFrame:
    """Per ticker: bars, the middle gap in days (upper middle) and whether the series is daily.
    Gaps are whole days, so the exact quantile keeps few distinct values."""
    w = Window.partitionBy("ticker").orderBy("d")
    gaps = bars.withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    return gaps.groupBy("ticker").agg(
        F.count("*").alias("bars"), upper_middle("gap").cast("bigint").alias("middle_gap")
    ).withColumn("is_daily", F.col("bars").__ge__(min_bars) & F.coalesce(F.col("middle_gap") <= max_gap, F.lit(False)))


def truncation(members: DataFrame, composite_bars: DataFrame, share: float = 0.6) -> DataFrame:
    """Per group: is the common-date composite (grp, bars) much shorter than its deepest member
    (grp, ticker, bars)? Names the shallowest member; of equally shallow ones the first, N2 before N12."""
    per = members.groupBy("grp").agg(
        F.max("bars").alias("deepest"),
        F.min_by("ticker", F.struct("bars", F.length("ticker"), "ticker")).alias("shallow_ticker"),
        F.min("bars").alias("shallow_bars"))
    return per.join(composite_bars.withColumnRenamed("bars", "composite"), "grp").withColumn(
        "truncated", F.col("composite") < F.col("deepest") * share)
