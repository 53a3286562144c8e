"""The forecast ledger: making dated claims, resolving them, grading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import fixed, ratio, with_group
from tidegauge.session import cut

TILT_DAYS, THEME_DAYS, SIZING_DAYS = 21, 42, 42
GRACE_DAYS = 180
OPPORTUNITY_THRESHOLD = 60


def price_on_or_after(wanted: DataFrame, bars: DataFrame, until: Column | None = None) -> DataFrame:
    """First close on or after each wanted (ticker, on): adds `price`, null when there is none yet.

    The wanted keys are reduced to distinct (ticker, day) pairs first, so the window holds at most two rows
    per ticker and day however many claims ask for the same price. It runs from the last day back and
    keeps the latest close it has met, which is one pass. No range join is involved.
    """
    asked = wanted.select("ticker", "on").distinct()
    known = bars if until is None else bars.where(F.col("d") <= until)
    both = known.select("ticker", "d", "close", F.lit(1).alias("_bar")).unionByName(
        asked.select("ticker", F.col("on").alias("d"), F.lit(None).cast("double").alias("close"), F.lit(0).alias("_bar")))
    back = Window.partitionBy("ticker").orderBy(F.desc("d"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("price", F.last("close", ignorenulls=True).over(back)).where(F.col("_bar") == 0)
    return wanted.join(found.select("ticker", F.col("d").alias("on"), "price"), ["ticker", "on"], "left")


# ---- making claims ---------------------------------------------------------------------------------

def anchorable(quotes: DataFrame) -> DataFrame:
    """Quotes a claim may be anchored on: priced, without error, not flagged as divergent."""
    return quotes.where((F.col("price") > 0) & F.coalesce("ok", F.lit(True)))


def tilt_claims(tilts: DataFrame, today: Column, horizon: int = TILT_DAYS) -> DataFrame:
    """One claim per over- or underweight name (ticker, tilt, price, ok)."""
    rows = anchorable(tilts).where(F.col("tilt").isin("overweight", "underweight"))
    return rows.select(
        F.concat_ws(":", today.cast("string"), F.lit("tsmom_tilt"), "ticker").alias("id"), today.alias("date"),
        F.lit("tsmom_tilt").alias("type"), F.col("ticker").alias("subject"),
        F.when(F.col("tilt") == "overweight", "up").otherwise("down").alias("claim"),
        F.col("price").alias("price_at"), F.date_add(today, horizon).alias("resolve_on"))


def deadline(text: Column) -> Column:
    """Year, year-month or date text to the last day it covers; anything else is null."""
    t = F.trim(text)
    return (F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31")).try_cast("date"))
            .when(t.rlike(r"^\d{4}-\d{2}$"), F.last_day(F.concat(t, F.lit("-01")).try_cast("date")))
            .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")))


def kill_claims(themes: DataFrame, today: Column) -> DataFrame:
    """A deadline-tracked claim per theme that states a condition and a date."""
    rows = themes.where((F.length("kill_condition") > 0) & F.col("kill_by").isNotNull()).withColumn(
        "resolve_on", deadline(F.col("kill_by"))).where(F.col("resolve_on").isNotNull())
    return rows.select(
        F.concat_ws(":", F.lit("kill"), "theme", "kill_by").alias("id"), today.alias("date"),
        F.lit("kill_criterion").alias("type"), F.col("theme").alias("subject"),
        F.lit("thesis_survives").alias("claim"), F.lit(None).cast("double").alias("price_at"), "resolve_on")


def theme_claims(signals: DataFrame, today: Column, horizon: int = THEME_DAYS) -> DataFrame:
    """One relative claim per theme (theme, flag, flow, score, basket_ok): the tape first, then forced
    selling into an intact thesis, then a high structural score."""
    tape = F.col("flag").isin("de-rating", "inflecting")
    flow = F.col("flow") == "accumulate"
    high = F.col("score") >= OPPORTUNITY_THRESHOLD
    source = F.when(tape, "de-rating").when(flow, "forced-flow").when(high, "opportunity")
    prefix = F.when(tape, "").when(flow, "ff:").otherwise("opp:")
    claim = F.when(F.col("flag") == "de-rating", "underperform").otherwise("outperform")
    return signals.where(F.col("basket_ok")).withColumn("source", source).where(F.col("source").isNotNull()).select(
        F.concat(today.cast("string"), F.lit(":scarcity_rel:"), prefix, F.col("theme")).alias("id"),
        today.alias("date"), F.lit("scarcity_rel").alias("type"), F.col("theme").alias("subject"),
        claim.alias("claim"), F.lit(None).cast("double").alias("price_at"),
        F.date_add(today, horizon).alias("resolve_on"), "source")


def new_claims(fresh: DataFrame, still_open: DataFrame, resolved_kills: DataFrame) -> DataFrame:
    """Fresh claims that are neither open already nor a kill claim resolved before."""
    known = still_open.select("id").unionByName(resolved_kills.select("id"))
    return fresh.join(known, "id", "left_anti")


# ---- resolving ---------------------------------------------------------------------------------------

def resolve_tilts(claims: DataFrame, bars: DataFrame, today: Column) -> DataFrame:
    """Status of each directional claim: open, resolved with its return, or expired ungraded."""
    due = F.col("resolve_on") <= today
    priced = price_on_or_after(
        claims.withColumnRenamed("subject", "ticker").withColumn("on", F.col("resolve_on")), bars, today)
    gain = F.when((F.col("price") > 0) & (F.col("price_at") > 0), F.col("price") / F.col("price_at") - 1)
    done = due & gain.isNotNull()
    status = (F.when(done, "resolved").when(F.col("resolve_on") < F.date_sub(today, GRACE_DAYS), "expired")
              .otherwise("open"))
    correct = F.when(done, F.when(F.col("claim") == "up", gain > 0).otherwise(gain < 0))
    return priced.select(
        "id", F.col("ticker").alias("subject"), "claim", "date", "resolve_on", status.alias("status"),
        F.when(done, gain).alias("realized_return"), correct.alias("correct"))


def resolve_kills(kills: DataFrame, themes: DataFrame, today: Column) -> DataFrame:
    """At its deadline a theme has survived (still listed) or was killed; a person reviews either way."""
    listed = themes.select(F.col("theme").alias("subject"), F.lit(True).alias("_listed"))
    rows = kills.where(F.col("resolve_on") <= today).join(listed, "subject", "left")
    return rows.select("id", "subject", "resolve_on",
                       F.when(F.col("_listed"), "survived").otherwise("killed").alias("outcome"),
                       F.lit(True).alias("needs_review"))


def window_returns(baskets: DataFrame, windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Equal-weight return of each basket (basket, ticker) over each of its windows (basket, date,
    resolve_on): every member's own return, over the members priced at both ends.

    Each distinct window is priced once, not once per claim that uses it, and both ends are looked up
    in the same pass over the bars.
    """
    legs = windows.distinct().join(baskets, "basket")
    ends = legs.withColumn("on", F.explode(F.array("date", "resolve_on")))
    priced = price_on_or_after(ends, bars).groupBy("basket", "date", "resolve_on", "ticker").agg(
        F.max(F.when(F.col("on") == F.col("date"), F.col("price"))).alias("_p0"),
        F.max(F.when(F.col("on") == F.col("resolve_on"), F.col("price"))).alias("_p1"))
    r = F.when((F.col("_p0") > 0) & (F.col("_p1") > 0), F.col("_p1") / F.col("_p0") - 1)
    return priced.groupBy("basket", "date", "resolve_on").agg(F.avg(r).alias("ret"))


def grade_theme_claims(claims: DataFrame, baskets: DataFrame, bars: DataFrame) -> DataFrame:
    """Grade relative claims (id, basket, complex, market, claim, date, resolve_on) against their
    complex and, separately, against the market; a market that cannot be priced is tallied."""
    days = ["date", "resolve_on"]
    sides = ["basket", "complex", "market"]
    windows = claims.select(*days, F.explode(F.array(*sides)).alias("basket"))
    rets = cut(window_returns(baskets, windows, bars))
    graded = claims
    for side in sides:
        graded = graded.join(rets.withColumnsRenamed({"basket": side, "ret": f"{side}_return"}), [side, *days], "left")
    rel = F.col("basket_return") - F.col("complex_return")
    rel_market = F.col("basket_return") - F.col("market_return")
    down = F.col("claim") == "underperform"
    return graded.where(rel.isNotNull()).select(
        "id", "basket", "claim", *days, fixed(rel, 4).alias("rel"),
        F.when(down, rel < 0).otherwise(rel > 0).alias("correct"), fixed(rel_market, 4).alias("rel_market"),
        F.when(down, rel_market < 0).otherwise(rel_market > 0).alias("correct_vs_market"),
        rel_market.isNull().alias("market_unresolved"))


def claim_states(claims: DataFrame, graded: DataFrame, today: Column) -> DataFrame:
    """Every claim (id, claim, resolve_on) with its state: resolved once due and graded (id, correct),
    expired if ungraded long after it was due, else open. No claim is lost."""
    done = (F.col("resolve_on") <= today) & F.col("correct").isNotNull()
    late = F.col("resolve_on") < F.date_sub(today, GRACE_DAYS)
    return claims.join(graded.select("id", "correct"), "id", "left").select(
        "id", "claim", "resolve_on", F.when(done, "resolved").when(late, "expired").otherwise("open").alias("status"),
        F.when(done, F.col("correct")).alias("correct"))


def grade_sizing(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Did the signal weights beat the research weights? `weights` has id, ticker, signal_weight,
    research_weight; `prices` has ticker, price_at, price_now. Weights are renormalised over the names
    priced at both ends."""
    rows = weights.join(prices, "ticker").where((F.col("price_at") > 0) & (F.col("price_now") > 0))
    r = F.col("price_now") / F.col("price_at") - 1

    def weighted(w: str) -> Column:
        return F.when(F.sum(w) > 0, ratio(F.sum(F.col(w) * r), F.sum(w)))

    out = rows.groupBy("id").agg(weighted("signal_weight").alias("signal_return"),
                                 weighted("research_weight").alias("research_return"))
    rel = F.col("signal_return") - F.col("research_return")
    return out.where(rel.isNotNull()).withColumn("rel", rel).withColumn("correct", rel > 0)


def normalized_weights(rows: DataFrame, key: str, signal: str, research: str) -> DataFrame:
    """Dollar targets of priced names as weights that sum to one per claim; two names at least."""
    sums = with_group(rows.where(F.col("price") > 0), [key], _s=F.sum(signal), _r=F.sum(research), _n=F.count("*"))
    return sums.where(F.col("_n") >= 2).select(
        F.col(key).alias("id"), "ticker", ratio(F.col(signal).cast("double"), F.col("_s").cast("double")).alias("signal_weight"),
        ratio(F.col(research).cast("double"), F.col("_r").cast("double")).alias("research_weight"))


# ---- scoring -------------------------------------------------------------------------------------------

def scorecard(resolved: DataFrame) -> DataFrame:
    """Hits and hit rates per (type, claim), per type and overall, from resolved claims (type, claim,
    correct, correct_vs_market, market_unresolved)."""
    graded = resolved.where(F.col("type") != "kill_criterion")
    out = graded.groupingSets([["type", "claim"], ["type"], []], "type", "claim").agg(
        F.count("*").alias("n"), F.count_if(F.col("correct")).alias("hits"),
        F.count("correct_vs_market").alias("n_ext"), F.count_if(F.col("correct_vs_market")).alias("hits_ext"),
        F.count_if(F.coalesce("market_unresolved", F.lit(False))).alias("unresolved_ext"))
    return out.select(
        F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("claim", F.lit("all")).alias("claim"),
        "n", "hits", ratio("hits", "n").alias("hit_rate"), "n_ext", "hits_ext",
        ratio("hits_ext", "n_ext").alias("hit_rate_ext"), "unresolved_ext")


def kill_tally(resolved_kills: DataFrame) -> DataFrame:
    return resolved_kills.agg(
        F.count("*").alias("matured"), F.count_if(F.col("outcome") == "survived").alias("survived"),
        F.count_if(F.col("outcome") == "killed").alias("killed"), F.count_if("needs_review").alias("needs_review"))


def alpha_label(attribution: DataFrame, resolved_relative: Column) -> DataFrame:
    """Relabel the scorecard's edge from the factor fit, so that a good hit rate cannot pass for skill."""
    known = F.col("verdict").isin("alpha", "factor/beta")
    return attribution.withColumns({
        "resolved": resolved_relative,
        "label": F.when(known, F.col("verdict")).otherwise("unproven"),
        "basis": F.when(known, "factor-adjusted").when(resolved_relative > 0, "forward-only").otherwise("building")})
