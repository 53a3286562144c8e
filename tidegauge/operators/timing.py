"""Trend, crash and thrust signals, the ladder built on them, and the stress overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import either_null
from tidegauge.operators.technicals import by_ticker, realized_vol, sma, with_bars

MIN_BARS = 211


def signals(bars: DataFrame) -> DataFrame:
    """Per bar (from the 211th): trend, crash_off, thrust and the numbers behind them.

    The 252-session return falls back to the first close of the series while it is shorter than that.
    """
    w = by_ticker()
    base = (
        with_bars(bars)
        .withColumn("sma200", sma(200)).withColumn("sma20", sma(20))
        .withColumn("_before", F.lag("sma20", 10).over(w))
        .withColumn("_start", F.coalesce(F.lag("close", 252).over(w), F.first("close").over(w)))
        .withColumn("ret252", F.col("close") / F.col("_start") - 1)
        .withColumn("vol60", realized_vol(60))
    )
    close = F.col("close")
    return base.select(
        "ticker", "d", "bar", "close", "prev", "sma200", "sma20", "ret252", "vol60",
        *[F.when(F.col("bar") >= MIN_BARS, c).alias(name) for name, c in {
            "trend": close > F.col("sma200"),
            "crash_off": (F.col("ret252") < 0) & F.coalesce(F.col("vol60") > 0.25, F.lit(False)),
            "thrust": (close > F.col("sma20")) & (F.col("sma20") > F.col("_before")),
        }.items()])


def ladder_rule() -> Column:
    """First rule that matches; null before the signals exist."""
    return (F.when(F.col("trend").isNull(), F.lit(None))
            .when(F.col("crash_off"), "crash").when(F.col("trend"), "trend")
            .when(F.col("thrust"), "thrust").otherwise("cash"))


def latest(frame: DataFrame, key: str = "ticker") -> DataFrame:
    """The last row of each series of a per-bar frame."""
    last = F.lead("d").over(Window.partitionBy(key).orderBy("d")).isNull()
    return frame.withColumn("_last", last).where("_last").drop("_last")


def ladder_state(latest_signals: DataFrame) -> DataFrame:
    """State and posture per series. `stress` is true, false or null (overlay suppressed); the overlay
    can only take risk off."""
    rule = ladder_rule()
    invested = rule.isin("trend", "thrust")
    overlay = invested & F.coalesce("stress", F.lit(False))
    posture = (F.when(rule.isNull(), "unknown").when(overlay, "defensive").when(rule == "trend", "risk-on")
               .when(rule == "thrust", "neutral").otherwise("defensive"))
    state = (F.when(rule.isNull(), "UNAVAILABLE").when(invested & ~overlay, "FULL").otherwise("DEFENSIVE"))
    return latest_signals.select(
        "ticker", "d", rule.alias("rule"), state.alias("state"), posture.alias("posture"),
        F.coalesce(overlay, F.lit(False)).alias("overlay_applied"),
        F.coalesce(posture == "neutral", F.lit(False)).alias("fast_reentry"), "trend", "crash_off", "thrust")


def term_inversion(pairs: DataFrame, key: str = "ticker", sessions: int = 3) -> DataFrame:
    """Pairs (key, d, near, far) on common dates: has near/far been at or above 1 on each of the last
    `sessions` dates? Null with too few dates. Counted back from the last date, whichever comes first
    decides: a ratio below 1 (false) or an unusable price (null)."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("d")))
    tail = pairs.withColumn("_k", back).where(F.col("_k") <= sessions)
    r = F.when(F.col("far") > 0, F.col("near") / F.col("far"))
    below, unusable = F.min(F.when(r < 1, F.col("_k"))), F.min(F.when(r.isNull(), F.col("_k")))
    inverted = F.when(below < F.coalesce(unusable, F.lit(sessions + 1)), False).when(unusable.isNull(), True)
    return tail.groupBy(key).agg(
        F.when(F.count("*") == sessions, inverted).alias("term_inverted"),
        F.max(F.when(F.col("_k") == 1, r)).alias("term_ratio"))


def spread_velocity(bars: DataFrame, win: int = 20, lookback: int = 252, share: float = 0.95) -> DataFrame:
    """Is the latest 20-session fall (log) in the top 5% of its last year, and a fall at all?

    Today reaches the 95th-percentile element exactly when at least floor(lookback*share)+1 of the
    last `lookback` velocities are no larger, so a conditional count replaces sorting.
    """
    w = by_ticker()
    whole = Window.partitionBy("ticker")
    moves = (
        bars.withColumn("_v", F.ln(F.lag("close", win).over(w) / F.col("close")))
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_back", F.col("_n") - F.row_number().over(w))
        .withColumn("_today", F.max(F.when(F.col("_back") == 0, F.col("_v"))).over(whole))
    )
    rank = F.count_if((F.col("_back") < lookback) & (F.col("_v") <= F.col("_today")))
    enough = F.max("_n") >= win + lookback + 1
    return moves.groupBy("ticker").agg(
        F.max("_today").alias("velocity"),
        F.when(enough, (rank >= int(lookback * share) + 1) & (F.max("_today") > 0)).alias("credit_stressed"))


def composite_stress(term: DataFrame, credit: DataFrame, key: str = "ticker") -> DataFrame:
    """Both legs must hold; if either cannot be computed the overlay is suppressed, not false."""
    a, b = F.col("term_inverted"), F.col("credit_stressed")
    missing = F.concat_ws(",", F.when(a.isNull(), "term"), F.when(b.isNull(), "credit"))
    both = term.join(credit, key, "full_outer")
    return both.select(key, a, b, either_null(a, b, a & b).alias("stress"),
                       (a.isNotNull() & b.isNotNull()).alias("available"), missing.alias("missing"))
