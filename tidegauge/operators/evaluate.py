"""Timing rules evaluated on history.

Each bar is decided on the bar before it, switches pay a cost, and the equity curve is the running
product of the daily factors. All of it is windows over (ticker; d): one shuffle per evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import align, metrics, timing
from tidegauge.operators.technicals import by_ticker, sma, with_bars


def equity(factor: Column, over=None) -> Column:
    """100 times the running product of positive factors."""
    w = (over or by_ticker()).rowsBetween(Window.unboundedPreceding, 0)
    return F.lit(100.0) * F.exp(F.sum(F.ln(factor)).over(w))


def timed_path(decided: DataFrame, start_bar: int, cost_bps: float, with_base: bool = False) -> DataFrame:
    """Equity of holding (`hold`) and of following yesterday's `position` (`timed`).

    `decided` has ticker, d, bar, close, prev and position (0 or 1, already lagged). The first
    position is not a switch. With `with_base`, the bar before the first is the base point 100.
    """
    w = by_ticker()
    rows = decided.where(F.col("bar") >= (start_bar - 1 if with_base else start_bar))
    pos = F.when(F.col("bar") >= start_bar, F.col("position"))
    rows = rows.withColumn("pos", pos)
    switched = F.coalesce(F.col("pos") != F.lag("pos").over(w), F.lit(False))
    ret = F.when(F.col("pos").isNotNull(), F.col("close") / F.col("prev")).otherwise(1.0)
    rows = rows.withColumn("switched", switched).withColumn("_ret", ret)
    factor = (F.when(F.col("pos") == 1, F.col("_ret")).otherwise(1.0)
              * F.when(F.col("switched"), F.lit(1 - max(0.0, cost_bps) / 10000)).otherwise(1.0))
    return rows.withColumn("hold", equity(F.col("_ret"))).withColumn("timed", equity(factor)).select(
        "ticker", "d", "bar", "pos", "switched", "hold", "timed")


def moving_average_path(bars: DataFrame, window: int = 200, cost_bps: float = 10, with_base: bool = False,
                        min_bars: int | None = None) -> DataFrame:
    """In the market while yesterday's close was above yesterday's moving average."""
    w = by_ticker()
    base = with_bars(bars).withColumn("_ma", sma(window)).withColumn(
        "_len", F.count("*").over(Window.partitionBy("ticker")))
    above = F.coalesce(F.lag("close").over(w) > F.lag("_ma").over(w), F.lit(False)).cast("int")
    decided = base.withColumn("position", above).where(F.col("_len") >= (min_bars or window + 2))
    return timed_path(decided, window + 1, cost_bps, with_base)


def ladder_path(bars: DataFrame, cost_bps: float = 10, min_rows: int = 60) -> DataFrame:
    """In the market while yesterday's ladder said so."""
    w = by_ticker()
    sig = timing.signals(bars).withColumn("_rule", timing.ladder_rule())
    decided = (
        sig.withColumn("position", F.lag("_rule").over(w).isin("trend", "thrust").cast("int"))
        .withColumn("_len", F.count("*").over(Window.partitionBy("ticker")))
        .where(F.col("_len") >= timing.MIN_BARS + max(30, min_rows))
    )
    return timed_path(decided, timing.MIN_BARS + 1, cost_bps)


def rule_summary(path: DataFrame, cost_bps: float = 10) -> DataFrame:
    """The moving-average rule against holding, from a path that includes the base point."""
    m = metrics.value_metrics(path, ["ticker"], ["timed", "hold"])
    use = path.groupBy("ticker").agg(
        F.count_if("switched").alias("whipsaws"), F.avg("pos").alias("time_in_market"),
        F.count("pos").alias("periods"))
    return m.join(use, "ticker").withColumn(
        "dd_reduction", F.col("hold_max_drawdown") - F.col("timed_max_drawdown")).withColumn(
        "turnover_cost_bps", F.col("whipsaws") * F.lit(float(cost_bps)))


def drawdown_episodes(path: DataFrame, keys: list[str], base: str, others: list[str],
                      min_depth: float = 0.20, digits: int = 6) -> DataFrame:
    """Peak-to-trough episodes of `base` at least `min_depth` deep, with the drawdown of the other
    columns between the same dates.

    A new episode starts on every bar at or above the running maximum, so the running count of those
    bars numbers the episodes. Whether another column helped compares drawdowns at presentation
    precision, as they are shown.
    """
    w = Window.partitionBy(*keys).orderBy("d")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col(base) >= F.max(base).over(before), F.lit(True)).cast("int")
    marked = path.withColumn("_fresh", fresh).withColumn(
        "_ep", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_ep").orderBy("d")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "_ep")
    marked = marked.withColumn("_trough", F.min(F.struct(F.col(base).alias("v"), F.col("d").alias("d"))).over(whole))
    for o in others:
        marked = marked.withColumn(f"_dd_{o}", 1 - F.col(o) / F.max(o).over(so_far))
    upto = F.col("d") <= F.col("_trough.d")
    agg = marked.groupBy(*keys, "_ep").agg(
        F.min("d").alias("from_d"), F.min("_trough.d").alias("to_d"),
        (1 - F.min("_trough.v") / F.max(base)).alias("depth"),
        *[F.max(F.when(upto, F.col(f"_dd_{o}"))).alias(f"{o}_dd") for o in others])
    out = agg.where(F.col("depth") >= min_depth).drop("_ep")
    out = out.withColumns({c: F.round(c, digits) for c in ["depth", *[f"{o}_dd" for o in others]]})
    for o in others:
        out = out.withColumn(f"{o}_helped", F.col(f"{o}_dd") < F.col("depth") - 0.005)
    return out


def rule_proof(path: DataFrame, min_rows: int = 60, blend: float | None = None) -> DataFrame:
    """Verdicts on a timed path without base point: does the rule cut the tail, is Calmar better?

    `blend` is the share of the book that can be timed; the rest is held, and the mix is reported as
    `mixed`. Verdicts compare metrics at presentation precision (4 digits).
    """
    values = ["hold", "timed"]
    if blend is not None:
        path = path.withColumn("mixed", blend * F.col("timed") + (1 - blend) * F.col("hold"))
        values.append("mixed")
    m = metrics.value_metrics(path, ["ticker"], values, digits=4).where(F.col("n") >= min_rows)
    use = path.groupBy("ticker").agg(
        F.min("d").alias("start_d"), F.max("d").alias("end_d"), F.count_if("switched").alias("switches"))
    low = F.lit(float("-inf"))
    return (
        m.join(use, "ticker")
        .withColumn("years", metrics.years_between(F.col("start_d"), F.col("end_d")))
        .withColumn("max_dd_reduction", F.round(F.col("hold_max_drawdown") - F.col("timed_max_drawdown"), 4))
        .withColumn("cagr_cost", F.round(F.coalesce("hold_cagr", F.lit(0.0)) - F.coalesce("timed_cagr", F.lit(0.0)), 4))
        .withColumn("reduces_tail", F.col("timed_max_drawdown") < F.col("hold_max_drawdown"))
        .withColumn("improves_calmar", F.coalesce("timed_calmar", low) > F.coalesce("hold_calmar", low))
    )


def breadth_path(series: DataFrame, window: int = 200, breadth_window: int = 20, threshold: float = 0.6,
                 notch: float = 0.5, cost_bps: float = 10, min_points: int = 60, min_names: int = 3) -> DataFrame:
    """Per group: holding its equal-weight index, a plain moving-average brake, and the brake with a
    partial re-entry when breadth was at the threshold on the last two bars."""
    members = align.usable_members(series, min_points)
    wide = members.groupBy("grp").agg(F.count("*").alias("_k")).where(F.col("_k") >= min_names)
    chosen = series.join(members.join(wide, "grp", "left_semi"), ["grp", "ticker"], "left_semi")
    rows = align.align(chosen)
    per_name = Window.partitionBy("grp", "ticker").orderBy("d")
    named = rows.withColumn("_ma", F.when(
        F.row_number().over(per_name) >= breadth_window,
        F.avg("close").over(per_name.rowsBetween(-(breadth_window - 1), 0))))
    breadth = named.groupBy("grp", "d").agg(F.avg((F.col("close") > F.col("_ma")).cast("int")).alias("breadth"))
    index = align.basket_index(chosen).join(breadth, ["grp", "d"])
    w = Window.partitionBy("grp").orderBy("d")
    base = (
        index.withColumn("bar", F.row_number().over(w))
        .withColumn("_len", F.count("*").over(Window.partitionBy("grp")))
        .where(F.col("_len") >= window + 60)
        .withColumn("_ma", F.when(F.col("bar") >= window, F.avg("value").over(w.rowsBetween(-(window - 1), 0))))
        .withColumn("_trend", F.lag("value").over(w) > F.lag("_ma").over(w))
        .withColumn("_wide", (F.lag("breadth").over(w) >= threshold) & (F.lag("breadth", 2).over(w) >= threshold))
        .withColumn("_ret", F.col("value") / F.lag("value").over(w))
        .where(F.col("bar") > window)
    )
    trend = F.coalesce("_trend", F.lit(False))
    early = F.coalesce("_wide", F.lit(False))
    path = base.withColumn("plain_pos", F.when(trend, 1.0).otherwise(0.0)).withColumn(
        "fast_pos", F.when(trend, 1.0).when(early, notch).otherwise(0.0))
    for side in ("plain", "fast"):
        p = F.col(f"{side}_pos")
        moved = F.coalesce(F.abs(p - F.lag(f"{side}_pos").over(w)), F.lit(0.0))
        path = path.withColumn(f"_f_{side}", (1 + p * (F.col("_ret") - 1)) * (1 - cost_bps / 10000 * moved))
    return path.select(
        "grp", "d", "bar", "plain_pos", "fast_pos",
        equity(F.col("_ret"), w).alias("hold"), equity(F.col("_f_plain"), w).alias("plain"),
        equity(F.col("_f_fast"), w).alias("fast"))


def breadth_proof(path: DataFrame) -> DataFrame:
    m = metrics.value_metrics(path, ["grp"], ["hold", "plain", "fast"], digits=4)
    use = path.groupBy("grp").agg(
        F.min("d").alias("start_d"), F.max("d").alias("end_d"),
        F.avg((F.col("plain_pos") > 0).cast("int")).alias("time_in_market_plain"),
        F.avg((F.col("fast_pos") > 0).cast("int")).alias("time_in_market_fast"))
    low, zero = F.lit(float("-inf")), F.lit(0.0)
    return (
        m.join(use, "grp")
        .withColumn("years", metrics.years_between(F.col("start_d"), F.col("end_d")))
        .withColumn("cagr_gain", F.round(F.coalesce("fast_cagr", zero) - F.coalesce("plain_cagr", zero), 4))
        .withColumn("maxdd_cost", F.round(F.col("fast_max_drawdown") - F.col("plain_max_drawdown"), 4))
        .withColumn("improves_cagr", F.coalesce("fast_cagr", low) > F.coalesce("plain_cagr", low))
        .withColumn("worth_it", F.coalesce("fast_calmar", low) > F.coalesce("plain_calmar", low))
    )

