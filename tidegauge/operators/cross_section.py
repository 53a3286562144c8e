"""Does trailing relative strength predict forward relative return across groups?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import average_rank, ratio
from tidegauge.operators.align import date_axis, offset_returns
from tidegauge.session import cut


def relative_pairs(series: DataFrame, members: DataFrame, complex_members: DataFrame, lookback: int = 63,
                   horizon: int = 42, step: int = 21) -> DataFrame:
    """(grp, idx, signal, forward) every `step` sessions of the union date axis.

    A group's return is the mean over its members priced at both ends of the window; the complex's
    return is subtracted. Prices are only ever looked up at fixed offsets of the date index.
    """
    axis = date_axis(series)
    trail = offset_returns(series, axis, lookback, "r")
    ahead = offset_returns(series, axis, horizon, "r").withColumn("idx", F.col("idx") - horizon)
    on_step = (F.col("idx") >= lookback) & ((F.col("idx") - lookback) % step == 0)

    def group_mean(returns: DataFrame, keys: DataFrame, by: list[str], out: str) -> DataFrame:
        return returns.where(on_step).join(keys, "ticker").groupBy(*by).agg(F.avg("r").alias(out))

    c = group_mean(trail, complex_members, ["idx"], "c_trail").join(
        group_mean(ahead, complex_members, ["idx"], "c_fwd"), "idx")
    g = group_mean(trail, members, ["grp", "idx"], "g_trail").join(
        group_mean(ahead, members, ["grp", "idx"], "g_fwd"), ["grp", "idx"])
    return g.join(c, "idx").select(
        "grp", "idx", (F.col("g_trail") - F.col("c_trail")).alias("signal"),
        (F.col("g_fwd") - F.col("c_fwd")).alias("forward"))


def rank_ic(pairs: DataFrame, min_pairs: int = 12) -> DataFrame:
    """One row: Spearman correlation of signal and forward return, sign hit rate and its 95% interval."""
    ranked = average_rank(average_rank(cut(pairs), "signal", "_rs"), "forward", "_rf")
    scored = F.col("signal") != 0
    hit = scored & (F.signum("signal") == F.signum("forward"))
    out = ranked.agg(
        F.count("*").alias("n"), F.corr("_rs", "_rf").alias("ic"),
        F.count_if(scored).alias("scored"), F.count_if(hit).alias("hits"))
    rate = ratio("hits", "scored")
    half = 1.96 * F.sqrt(rate * (1 - rate) / F.col("scored"))
    return out.where(F.col("n") >= min_pairs).select(
        "n", "ic", "scored", "hits", rate.alias("hit_rate"),
        (rate - half).alias("hit_low"), (rate + half).alias("hit_high"))
