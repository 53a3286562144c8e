"""Screening an option chain against realised volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import options
from tidegauge.functions.scalar import ratio


def evaluate(chain: DataFrame) -> DataFrame:
    """Implied volatility, fair value at realised volatility, verdict and greeks per contract.

    `chain` has kind, spot, strike, days, market and ref_vol (nullable).
    """
    kind, s, k, market, ref = (F.col(c) for c in ("kind", "spot", "strike", "market", "ref_vol"))
    t = F.greatest(F.col("days"), F.lit(0)) / 365.0
    rows = chain.withColumn("_t", t)
    t = F.col("_t")
    rows = rows.withColumn("implied_vol", options.implied_vol(kind, s, k, t, market))
    iv = F.col("implied_vol")
    fair = F.when(ref > 0, options.price(kind, s, k, t, ref))
    to_realized = F.when(ref > 0, ratio(iv, ref))
    rows = rows.withColumns({
        "intrinsic": F.greatest(F.lit(0.0), F.when(kind == "put", k - s).otherwise(s - k)),
        "iv_to_realized": to_realized, "fair_value": fair, "edge": market - fair,
        "verdict": options.fairness(to_realized)})
    return rows.withColumns(options.greeks(kind, s, k, t, iv)).drop("_t")


def summarize(evaluated: DataFrame) -> DataFrame:
    """Per underlying: contracts, solved share, mean implied volatility and verdict counts."""
    return evaluated.groupBy("underlying").agg(
        F.count("*").alias("contracts"), F.count("implied_vol").alias("solved"),
        F.avg("implied_vol").alias("mean_iv"), F.avg("iv_to_realized").alias("mean_ratio"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("cheap", "fair", "rich")])


def at_the_money(chain: DataFrame) -> DataFrame:
    """Implied volatility at the strike nearest to spot, the mean of the call's and the put's."""
    distance = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"), F.col("contract"))
    sides = chain.groupBy("underlying", "kind").agg(F.min_by("iv", distance).alias("_iv"))
    return sides.where(F.col("_iv") > 0).groupBy("underlying").agg(F.avg("_iv").alias("atm_iv"))
