"""Screening second-axis baskets against the book, and funding the ones that qualify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import fixed, half_up, with_group
from tidegauge.operators import align, metrics, regression
from tidegauge.session import cut


def gate_passes(axis: Column, residual_beta: Column, beta_max: float = 0.3) -> Column:
    """Only diversifiers are gated; a missing loading never fails."""
    return (axis != "diversifier") | residual_beta.isNull() | (residual_beta <= beta_max)


def screen(candidates: DataFrame, market: DataFrame, complex_: DataFrame, plan: DataFrame,
           beta_max: float = 0.3, market_beta_max: float = 0.95, dd_cap: float = 0.5,
           min_dates: int = 60) -> DataFrame:
    """Rank candidate baskets (grp, ticker, d, close) as diversifiers of the plan index (d, value).

    Market and complex are daily returns (d, ret). Each candidate gets basket metrics, its residual
    loading, and the drawdown of a 50/50 mix with the plan compared with the plan's own.
    """
    index, plan = cut(align.basket_index(candidates)), cut(plan)
    stats = metrics.basket_stats(index, min_points=60)
    load = regression.residual_loading(
        align.basket_returns(candidates), market, complex_, beta_max=beta_max, min_dates=min_dates)
    plan_dd = metrics.series_metrics(plan.withColumn("_p", F.lit(1)), ["_p"]).select("max_drawdown").scalar()
    both = index.join(plan.select("d", F.col("value").alias("_plan")), "d")
    start = both.groupBy("grp").agg(
        F.min_by("value", "d").alias("_v0"), F.min_by("_plan", "d").alias("_p0"), F.count("*").alias("_n"))
    mixed = both.join(start.where(F.col("_n") >= min_dates), "grp").select(
        "grp", "d", (50 * (F.col("value") / F.col("_v0") + F.col("_plan") / F.col("_p0"))).alias("value"))
    mix = metrics.series_metrics(mixed, ["grp"]).select("grp", F.col("max_drawdown").alias("blended_max_dd"))
    asked = candidates.select("grp").distinct()  # a candidate without enough prices keeps its row
    out = asked.join(stats, "grp", "left").join(load.drop("n", "qualifies"), "grp", "left").join(mix, "grp", "left")
    gated = gate_passes(F.lit("diversifier"), F.col("residual_beta"), beta_max)
    known = F.col("residual_beta").isNotNull() & F.col("n").isNotNull()
    reason = (
        F.when(~known, "insufficient price history").when(~gated, "amplifies the build-out")
        .when(F.col("market_beta") > market_beta_max, "moves too much with the market")
        .when(F.col("max_drawdown") > dd_cap, "drawdown over the cap")
        .when(F.col("dd_reduction") <= 0, "qualifies, redundant with the plan")
        .otherwise("qualifies"))
    return (
        out.withColumn("dd_reduction", plan_dd - F.col("blended_max_dd"))
        .withColumn("reason", reason)
        .withColumn("qualifies", F.col("reason").startswith("qualifies"))
        .orderBy(F.desc("qualifies"), F.desc_nulls_last("dd_reduction"), F.desc_nulls_last("sharpe"),
                 F.asc_nulls_last("max_drawdown"), "grp")
    )


def parse_conviction(text: Column) -> Column:
    """A 0..1 conviction out of a reply: the number after the JSON field, else the first word that is
    itself a number from 0 to 1."""
    after = F.get(F.split(F.lower(text), '"conviction"\\s*:', 2), 1)
    words = F.transform(F.split(text, r"[^\w.]+"), lambda w: F.rtrim(w, F.lit(".")))
    plain = F.filter(words, lambda w: w.rlike(r"^[01]?(\.\d+)?$") & w.try_cast("double").between(0, 1))
    value = F.coalesce(F.regexp_extract(F.trim(after), r"^-?[\d.]+", 0).try_cast("double"), F.get(plain, 0).try_cast("double"))
    return F.when(value < 0, 0.0).when(value > 1, 1.0).otherwise(F.round(value, 3))


def conviction(replies: DataFrame, key: str, fallback: float = 0.6) -> DataFrame:
    """Mean conviction per key over the replies that contain one; the fallback when none does."""
    return replies.withColumn("_c", parse_conviction(F.col("text"))).groupBy(key).agg(
        F.coalesce(F.avg("_c"), F.lit(fallback)).alias("conviction"), F.count("_c").alias("votes"))


def fund_sleeve(names: DataFrame, holdings: DataFrame, sleeve_pct: float = 0.15, max_names: int = 0,
                vol_floor: float = 0.01, default_vol: float = 0.25, default_conviction: float = 0.6) -> DataFrame:
    """Weights of new diversifier names per portfolio.

    `names` (portfolio_id, ticker, conviction, vol) not yet held share the budget left by the existing
    diversifiers in proportion to conviction over volatility. `holdings` needs portfolio_id, ticker,
    weight, is_diversifier.
    """
    fresh = names.join(holdings.select("portfolio_id", "ticker"), ["portfolio_id", "ticker"], "left_anti")
    fresh = fresh.withColumn("conviction", F.coalesce("conviction", F.lit(default_conviction)))
    if max_names > 0:
        order = Window.partitionBy("portfolio_id").orderBy(F.desc("conviction"), "ticker")
        fresh = fresh.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_names).drop("_k")
    existing = holdings.groupBy("portfolio_id").agg(
        F.coalesce(F.sum(F.when(F.col("is_diversifier"), F.col("weight"))), F.lit(0.0)).alias("existing"))
    raw = F.col("conviction") / F.greatest(F.coalesce("vol", F.lit(default_vol)), F.lit(vol_floor))
    shared = with_group(fresh.withColumn("_raw", raw), ["portfolio_id"], _sum=F.sum("_raw"))
    existing_or_none = F.coalesce("existing", F.lit(0.0))  # a book without holdings has its whole budget
    budget = F.greatest(F.lit(0.0), F.round(sleeve_pct - existing_or_none, 6))
    weight = fixed(budget * F.col("_raw") / F.col("_sum"), 4)
    return (shared.join(existing, "portfolio_id", "left")
            .select("portfolio_id", "ticker", "conviction", budget.alias("budget"), existing_or_none.alias("existing"), weight.alias("weight"))
            .where(F.col("weight") > 0))


def apply_funding(holdings: DataFrame, funding: DataFrame) -> DataFrame:
    """Holdings with the funded names added and the build-out scaled so that the weights still sum to one.

    Holdings carry `sleeve_usd`, the portfolio's total. A portfolio that already holds a proposed name
    was funded before and comes back unchanged, so applying twice is harmless.
    """
    key = "portfolio_id"
    done = funding.join(holdings.select(key, "ticker"), [key, "ticker"], "left_semi").select(key).distinct()
    todo = funding.join(done, key, "left_anti")
    left = (1 - F.max("existing") - F.sum("weight")) / F.nullif(1 - F.max("existing"), F.lit(0.0))
    # weights carry four decimals, so ten digits drop only the noise of the sums, and a half goes up whatever their order
    scale = todo.groupBy(key).agg(F.round(F.round(left, 10), 4).alias("_scale"))
    scaled = F.col("_scale").isNotNull() & ~F.col("is_diversifier")
    weight = F.when(scaled, fixed(F.col("weight") * F.col("_scale"), 4)).otherwise(F.col("weight"))
    old = holdings.join(scale, key, "left").select(
        key, "ticker", weight.alias("weight"),
        F.when(scaled, half_up(weight * F.col("sleeve_usd"))).otherwise(F.col("target_usd")).alias("target_usd"))
    sleeves = holdings.groupBy(key).agg(F.max("sleeve_usd").alias("sleeve_usd"))
    added = todo.join(sleeves, key, "left").select(  # the amount is unknown where there is no book yet
        key, "ticker", "weight", half_up(F.col("weight") * F.col("sleeve_usd")).alias("target_usd"))
    return old.unionByName(added)
