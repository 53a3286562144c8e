"""Scores and flags per name and per theme. Row-wise rules are column expressions; theme-level
rules join members to quotes and aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import clamp, fixed, half_up, lookup, lower_middle, ratio, upper_middle
from tidegauge.operators.quality import has_bad_data

# Weights of the ordered labels.
PRICED_GATE = {"low": 1.0, "medium": 0.66, "high": 0.33, "crowded": 0.0}
BIND_PROXIMITY = {"now": 1.0, "2027": 0.85, "2028-29": 0.65, "2030+": 0.45, "physics-floor": 0.6}
DURABILITY = {"very-high": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
DEFENSIBILITY = {"low": 1.0, "medium": 0.5, "high": 0.0}
STAGE = {"good": 1.0, "fair": 0.6, "stretched": 0.34, "n/a": 1.0}
ENTRY_WEIGHTS = {"dislocation": 0.22, "trend": 0.20, "momentum": 0.20, "relstrength": 0.18, "valuation": 0.20}
TAX = {"ordinary": 0.35, "qualified": 0.15, "ltcg": 0.15}


# ---- per name ------------------------------------------------------------------------------------

def crowding(ytd: Column, off_high: Column, flags: Column | None = None) -> Column:
    """0..100 from the year's gain and the distance to the high; null on bad data or without ytd."""
    run = clamp(ytd * 100, 0.0, 60.0)
    near = F.coalesce(clamp(40 * (1 + off_high / 0.25), 0.0, 40.0), F.lit(0.0))
    score = half_up(clamp(run + near, 0.0, 100.0))
    bad = F.coalesce(has_bad_data(flags), F.lit(False)) if flags is not None else F.lit(False)
    return F.when(ytd.isNotNull() & ~bad, score)


def dislocation(off_high: Column, mom_1m: Column, above_ma200: Column) -> Column:
    """0..1: distance below the high (0.6), below the long average (0.2), falling month (0.2)."""
    deep = F.coalesce(clamp(-off_high / 0.4, 0.0, 1.0), F.lit(0.0)) * 0.6
    below = F.when(~above_ma200, 0.2).otherwise(0.0)
    falling = F.coalesce(F.when(mom_1m < 0, clamp(-mom_1m / 0.2, 0.0, 1.0)), F.lit(0.0)) * 0.2
    return F.when(off_high.isNotNull() | mom_1m.isNotNull(),
                  fixed(F.least(F.lit(1.0), deep + below + falling), 3))


def momentum_tilt(mom_12m: Column, above_ma200: Column) -> Column:
    return (F.when(mom_12m.isNull(), "n/a")
            .when((mom_12m > 0) & above_ma200, "overweight")
            .when((mom_12m < 0) & ~above_ma200, "underweight").otherwise("neutral"))


def entry_quality(df: DataFrame) -> DataFrame:
    """Score, label and reasons from whichever legs are present.

    Reads off_high (a positive fraction), above_ma200, mom_12m, mom_1m, rel_strength and val_tag.
    """
    off, trend, m, m1 = F.col("off_high"), F.col("above_ma200"), F.col("mom_12m"), F.col("mom_1m")
    rs, tag = F.col("rel_strength"), F.col("val_tag")
    falling_knife = F.coalesce((off > 0.45) & ~trend, F.lit(False))
    rise = F.when(m <= 0.4, clamp(0.6 + m, 0.0, 1.0)).otherwise(clamp(1 - (m - 0.4), 0.0, 1.0))
    ran_up = F.coalesce(m1 > 0.15, F.lit(False))
    legs = {
        "dislocation": clamp(off / 0.25, 0.0, 1.0) * F.when(falling_knife, 0.4).otherwise(1.0),
        "trend": F.when(trend, 0.55).when(~trend, 0.2),
        "momentum": F.when(m.isNotNull(), rise * F.when(ran_up, 0.7).otherwise(1.0)),
        "relstrength": clamp(0.5 + rs / 2, 0.0, 1.0),
        "valuation": F.when(tag == "cheap", 0.9).when(tag == "rich", 0.2).when(tag.isNotNull(), 0.55),
    }
    zero = F.lit(0.0)
    total = sum((F.coalesce(F.lit(ENTRY_WEIGHTS[k]) * leg, zero) for k, leg in legs.items()), zero)
    weight = sum((F.when(leg.isNotNull(), ENTRY_WEIGHTS[k]).otherwise(zero) for k, leg in legs.items()), zero)
    score = half_up(ratio(F.lit(100.0) * total, weight))
    label = (F.when(F.col("score").isNull(), "n/a").when(F.col("score") >= 66, "good")
             .when(F.col("score") >= 40, "fair").otherwise("stretched"))
    reasons = F.array_compact(F.array(
        F.when(off.isNotNull(), F.concat(half_up(off * 100).cast("string"), F.lit("% off high"))),
        F.when(trend, "above 200-DMA").when(~trend, "below 200-DMA"),
        F.when(m.isNotNull(), F.concat(
            F.lit("12m "), F.when(m >= 0, "+").otherwise(""), half_up(m * 100).cast("string"), F.lit("%"),
            F.when(ran_up, " (just ran up)").when(m > 1, " (extended)").otherwise(""))),
        F.when(rs > 0.05, "inflecting vs complex").when(rs < -0.05, "de-rating vs complex")
        .when(rs.isNotNull(), "neutral vs complex"),
        tag))
    return df.withColumn("score", score).withColumn("label", label).withColumn("reasons", reasons)


def stage_buy(label: Column, amount: Column) -> tuple[Column, Column]:
    """(now, later) split of an amount by entry label."""
    amount = F.coalesce(amount, F.lit(0))
    now = half_up(amount * lookup(label, STAGE, 1.0))
    return now, F.greatest(F.lit(0).cast("bigint"), half_up(amount - now))


def legibility(financial: Column, primary: Column) -> tuple[Column, Column]:
    """(tag, penalty): heavy mainstream coverage is a discount, never a veto."""
    known = (financial >= 10) & (financial > primary)
    return (F.when(known, "already-legible").otherwise("early-contrarian"),
            F.when(known, fixed(F.least(F.lit(0.3), financial / 100), 3)).otherwise(0.0))


def chokepoint_heat(proxy_mom: Column, complex_mom: Column, news: Column) -> tuple[Column, Column]:
    """(heat 0..100, momentum relative to the complex)."""
    news_part = clamp(F.coalesce(news, F.lit(0)) / 5.0, 0.0, 1.0)
    mom_part = clamp(0.5 + proxy_mom * 5, 0.0, 1.0)
    heat = F.when(mom_part.isNull(), news_part).otherwise((news_part + mom_part) / 2)
    return half_up(F.lit(100.0) * heat), proxy_mom - complex_mom


def tax_loss_window(d: Column) -> Column:
    month = F.month(d)
    return F.when(month.isin(11, 12), "selling").when(month == 1, "rebound")


def entry_window(any_dislocation: Column, drawdown_fired: Column, state: Column, fast_reentry: Column):
    """(window, reasons) for acting on a dislocation: it must exist and timing must have turned."""
    turns = F.array_compact(F.array(
        F.when(drawdown_fired, F.lit("drawdown trigger")),
        F.when(state == "FULL", F.lit("trend re-confirmed")),
        F.when(fast_reentry, F.lit("fast re-entry"))))
    window = (F.when(~any_dislocation, "none").when(F.size(turns) > 0, "open").otherwise("wait"))
    return window, F.when(window == "open", turns).otherwise(F.array().cast("array<string>"))


# ---- themes --------------------------------------------------------------------------------------

def opportunity(themes: DataFrame) -> DataFrame:
    """Add gate, static_gate, quality and score; `crowding` (nullable) is the live mean crowding."""
    static = lookup("priced_in", PRICED_GATE, 0.5)
    live = clamp(1 - F.col("crowding") / 100, 0.0, 1.0)
    gate = F.coalesce(0.6 * static + 0.4 * live, static)
    quality = (0.40 * lookup("bind_window", BIND_PROXIMITY, 0.5) + 0.35 * lookup("durability", DURABILITY, 0.5)
               + 0.25 * lookup("substitution_risk", DEFENSIBILITY, 0.5))
    bonus = F.when(F.col("non_consensus"), 1.15).otherwise(1.0)
    return themes.withColumns({
        "gate": gate, "static_gate": static, "live_gate": live, "quality": quality, "bonus": bonus,
        "score": half_up(F.least(F.lit(100.0), F.lit(100.0) * gate * quality * bonus))})


def rank_opportunities(scored: DataFrame) -> DataFrame:
    """Build-out themes by score; diversifiers are never ranked."""
    return scored.where(F.coalesce(F.col("axis"), F.lit("deep-tech")) != "diversifier").orderBy(
        F.desc("score"), "theme")


def member_mean(members: DataFrame, values: DataFrame, value: str, out: str) -> DataFrame:
    """Mean of a per-ticker value per theme (over the members that have one)."""
    return members.join(values.select("ticker", value), "ticker").groupBy("theme").agg(
        F.avg(value).alias(out), F.count(value).alias(f"{out}_n"))


def relative_strength(members: DataFrame, quotes: DataFrame, complex_mom: Column) -> DataFrame:
    """Mean one-month momentum of a theme's members minus that of the complex."""
    mean = member_mean(members, quotes, "mom_1m", "_m").where(F.col("_m").isNotNull())
    return mean.select("theme", fixed(F.col("_m") - complex_mom, 4).alias("rs"))


def derating_flag(priced_in: Column, rs: Column, threshold: float = 0.03) -> Column:
    return (F.when(priced_in.isin("high", "crowded") & (rs <= -threshold), "de-rating")
            .when(priced_in.isin("low", "medium") & (rs >= threshold), "inflecting").otherwise("none"))


def ticker_strength(members: DataFrame, theme_rs: DataFrame) -> DataFrame:
    """Mean relative strength of the themes a ticker belongs to."""
    return members.join(theme_rs, "theme").groupBy("ticker").agg(fixed(F.avg("rs"), 4).alias("rel_strength"))


def ticker_opportunity(members: DataFrame, scored: DataFrame) -> DataFrame:
    """Best thesis-only opportunity per ticker; live prices are left out so that momentum enters a
    weight only once."""
    static = F.least(F.lit(100.0), F.lit(100.0) * fixed("static_gate", 2) * fixed("quality", 2) * F.col("bonus"))
    return members.join(scored.select("theme", static.alias("_s")), "theme").groupBy("ticker").agg(
        F.max("_s").alias("opportunity"))


def forced_flow(members: DataFrame, quotes: DataFrame, scores: DataFrame, on: Column, min_names: int = 2,
                dislocated: float = 0.5, intact_score: float = 55) -> DataFrame:
    """Mean dislocation per theme and whether it meets an intact thesis (accumulate) or not (broken)."""
    q = quotes.select("ticker", dislocation(F.col("pct_off_high"), F.col("mom_1m"), F.col("above_ma200")).alias("dis"))
    d = member_mean(members, q, "dis", "_d")
    intact = F.coalesce(F.col("score") >= intact_score, F.lit(False))
    deep = (F.col("n") >= min_names) & (F.col("dislocation") >= dislocated)
    return scores.select("theme", "score").join(
        d.select("theme", fixed("_d", 3).alias("dislocation"), F.col("_d_n").alias("n")), "theme", "left").select(
        "theme", "dislocation", F.coalesce("n", F.lit(0)).alias("n"), tax_loss_window(on).alias("window"),
        F.when(F.col("n") > 0, intact).alias("intact"),
        F.when(deep & intact, "accumulate").when(deep & F.col("score").isNotNull(), "broken")
        .otherwise("none").alias("flag"))


def subordinate_to_timing(flow: DataFrame, posture: Column, macro_stressed: Column) -> DataFrame:
    """An accumulate flag waits for the trigger while the brakes are on."""
    brakes = (posture == "defensive") | F.coalesce(macro_stressed, F.lit(False))
    waiting = F.when(F.col("flag") == "accumulate", brakes)
    return flow.withColumns({
        "subordinate_to_timing": waiting,
        "guidance": F.when(waiting, "deploy on trigger").when(~waiting, "accumulate")})


# ---- portfolios ------------------------------------------------------------------------------------

def regime_components(members: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cross-section of a portfolio's composite: trend, momentum, breadth and volatility state."""
    vol_ratio = F.when((F.col("vol_3m") > 0) & (F.col("vol_1y") > 0), F.col("vol_3m") / F.col("vol_1y"))
    rows = members.join(quotes, "ticker").withColumn("_vr", vol_ratio)
    n = F.count("*")
    return rows.groupBy("portfolio_id").agg(
        n.alias("names"), F.avg("pct_vs_ma200").alias("trend_vs_200dma"), F.avg("mom_12m").alias("momentum_12m"),
        F.avg("pct_off_high").alias("avg_off_high"), F.avg(F.col("above_ma200").cast("int")).alias("breadth_200"),
        F.avg(F.col("above_ma20").cast("int")).alias("breadth_20"), upper_middle("_vr").alias("vol_state"),
        F.when(n >= 6, "high").when(n >= 3, "medium").otherwise("low").alias("confidence"))


def position_usd(positions: DataFrame, quotes: DataFrame, securities: DataFrame, rates: DataFrame) -> DataFrame:
    """Market value in dollars. An unknown currency on a foreign name, or a missing rate, excludes the
    position (null) instead of assuming parity."""
    rows = (positions.join(quotes.select("ticker", "price"), "ticker", "left")
            .join(securities.select("ticker", "currency", "is_foreign"), "ticker", "left"))
    currency = F.coalesce("currency", F.when(F.col("is_foreign"), "UNKNOWN").otherwise("USD"))
    rows = rows.withColumn("currency", currency).join(rates, "currency", "left")
    rate = F.when(F.col("currency") == "USD", 1.0).when(F.col("rate") > 0, F.col("rate"))
    return rows.withColumn("usd", rate * F.col("price") * F.col("shares"))


def sleeve_value(valued: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """Value per portfolio of its priced positions plus its cash (portfolio_id, cash_usd; one row each);
    null where no position has a price, with what is missing."""
    held = F.col("shares") > 0
    sums = valued.groupBy("portfolio_id").agg(
        F.sum("usd").alias("_usd"), F.count("usd").alias("priced"),
        F.count_if(held & F.col("price").isNull()).alias("missing_price"),
        F.count_if(held & F.col("price").isNotNull() & F.col("usd").isNull()).alias("missing_rate"))
    paid_in = F.lit(0.0)
    if cash is not None:
        sums, paid_in = sums.join(cash.select("portfolio_id", "cash_usd"), "portfolio_id", "left"), F.coalesce("cash_usd", F.lit(0.0))
    value = F.when(F.col("priced") > 0, half_up(F.round(F.col("_usd") + paid_in, 6)))
    return sums.select("portfolio_id", value.alias("sleeve_usd"), "priced", "missing_price", "missing_rate")


def trim_candidates(positions: DataFrame, quotes: DataFrame, min_gain: float = 2, min_pe: float = 50) -> DataFrame:
    """Names at twice their cost or more that also trade above 50 times forward earnings."""
    rows = positions.join(quotes.select("ticker", "price"), "ticker").where(F.col("cost_basis") > 0)
    gain = F.col("price") / F.col("cost_basis")
    return rows.where((gain >= min_gain) & (F.col("forward_pe") > min_pe)).select(
        "portfolio_id", "ticker", gain.alias("gain"), "forward_pe")


def trigger_conditions(sleeves: DataFrame, trims: DataFrame, average_drawdown: Column, degraded: Column,
                       drawdown_limit: float = 0.2, sleeve_cap: float = 1_720_000) -> DataFrame:
    """Which automatic triggers are met per portfolio; none is while the data is degraded."""
    counts = trims.groupBy("portfolio_id").agg(F.count("*").alias("trim_hits"))
    hits = F.coalesce("trim_hits", F.lit(0))
    good = ~degraded
    return sleeves.join(counts, "portfolio_id", "left").select(
        "portfolio_id", "sleeve_usd", hits.alias("trim_hits"),
        (good & F.coalesce(F.abs(average_drawdown) >= drawdown_limit, F.lit(False))).alias("drawdown_met"),
        (good & F.coalesce(F.col("sleeve_usd") >= sleeve_cap, F.lit(False))).alias("sleeve_met"),
        (good & (hits > 0)).alias("trim_met"))


def trigger_edges(scans: DataFrame, key: str = "trigger", order: str = "d") -> DataFrame:
    """Two-scan confirmation and the scans on which a trigger newly fires, from (trigger, d, met)."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag("met").over(w), F.lit(False))
    fired = scans.withColumn("fired", F.col("met") & before).withColumn("pending", F.col("met") & ~before)
    return fired.withColumn("newly_fired", F.col("fired") & ~F.coalesce(F.lag("fired").over(w), F.lit(False)))


def after_tax_multiples(holdings: DataFrame, years: int = 20) -> DataFrame:
    """Terminal value of a dollar per holding and account type, with the yearly drag and the rank."""
    is_div = F.col("sleeve") == "diversifier"
    tactical = (F.col("account") == "ira") | F.col("role").rlike("(?i)tactical")
    y = F.when(is_div, 0.030).otherwise(0.008)
    g = F.when(is_div, 0.04).otherwise(0.09)
    turnover = F.when(tactical, 0.2).otherwise(0.05)
    drag = y * TAX["qualified"] + turnover * 0.08 * TAX["ltcg"]
    grown = F.pow(1 + g, years)
    taxed = 1 + (F.pow(F.greatest(F.lit(0.0), 1 + g - y * TAX["qualified"]), years) - 1) * (1 - TAX["ltcg"])
    kinds = {"roth": grown, "traditional": grown * (1 - TAX["ordinary"]), "taxable": taxed}
    ranked = F.array_sort(F.array(*[F.struct((-m).alias("less"), F.lit(k).alias("location")) for k, m in kinds.items()]))
    rows = holdings.withColumn("annual_drag", drag).select("*", F.posexplode(ranked).alias("place", "_best"))
    return rows.withColumns({"location": F.col("_best.location"), "multiple": -F.col("_best.less"), "place": F.col("place") + 1}).drop("_best")


# ---- valuation ---------------------------------------------------------------------------------------

REVENUE_CONCEPTS = ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"]


def trailing_earnings(facts: DataFrame) -> DataFrame:
    """Trailing diluted earnings per share: the four latest distinct quarters, else the latest year."""
    eps = facts.where((F.col("concept") == "EarningsPerShareDiluted") & F.col("val").isNotNull() & F.col("end_d").isNotNull())
    quarter = eps.where(F.abs(F.datediff("end_d", "start_d") - 91) <= 25)
    one = quarter.groupBy("ticker", "end_d").agg(F.max("val").alias("val"))
    last4 = one.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("end_d")))).where(
        F.col("_k") <= 4)
    ttm = last4.groupBy("ticker").agg(F.when(F.count("*") == 4, fixed(F.sum("val"), 2)).alias("_ttm"))
    yearly = eps.where(is_annual()).groupBy("ticker").agg(F.max_by("val", F.struct("end_d", "val")).alias("_year"))
    return ttm.join(yearly, "ticker", "full_outer").select("ticker", F.coalesce("_ttm", "_year").alias("eps_ttm"))


def is_annual() -> Column:
    return (F.col("fp") == "FY") | (F.col("form") == "10-K")


def fundamentals(facts: DataFrame) -> DataFrame:
    """Revenue growth and net margin from annual facts; the first revenue concept reported is used."""
    annual = facts.where(is_annual() & F.col("val").isNotNull() & F.col("end_d").isNotNull())
    rank = lookup("concept", {c: i for i, c in enumerate(REVENUE_CONCEPTS)})
    revenue = annual.withColumn("_r", rank).where(F.col("_r").isNotNull())
    best = revenue.groupBy("ticker").agg(F.min("_r").alias("_r"))
    per_year = revenue.join(best, ["ticker", "_r"]).groupBy("ticker", "end_d").agg(F.max("val").alias("val"))
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("end_d")))
    two = per_year.withColumn("_k", k).where(F.col("_k") <= 2).groupBy("ticker").agg(
        F.max(F.when(F.col("_k") == 1, F.col("val"))).alias("_now"), F.max(F.when(F.col("_k") == 2, F.col("val"))).alias("_before"))
    income = annual.where(F.col("concept") == "NetIncomeLoss").groupBy("ticker").agg(
        F.max_by("val", F.struct("end_d", "val")).alias("_ni"))
    return two.join(income, "ticker", "left").select(
        "ticker", F.when(F.col("_before") > 0, fixed(F.col("_now") / F.col("_before") - 1, 3)).alias("revenue_yoy"),
        F.when(F.col("_now") > 0, fixed(F.col("_ni") / F.col("_now"), 3)).alias("net_margin"))


def valuation(facts: DataFrame, quotes: DataFrame, vendor: DataFrame, divergence: float = 0.15) -> DataFrame:
    """Trailing P/E from reported facts checked against a vendor's (ticker, vendor_pe)."""
    own = (quotes.select("ticker", "price").join(trailing_earnings(facts), "ticker", "left")
           .join(fundamentals(facts), "ticker", "left").join(vendor, "ticker", "left"))
    reported = F.when((F.col("eps_ttm") > 0) & (F.col("price") > 0), fixed(F.col("price") / F.col("eps_ttm"), 1))
    a, b = F.col("reported_pe"), F.col("vendor_pe")
    middle = (a + b) / 2
    spread = (F.greatest(a, b) - F.least(a, b)) / middle
    # two values are equally far from their midpoint: both are near it or neither is
    near = F.abs(a / middle - 1) <= divergence
    both = a.isNotNull() & b.isNotNull()
    return own.withColumn("reported_pe", reported).select(
        "ticker", "eps_ttm", "revenue_yoy", "net_margin",
        F.when(both, fixed(F.when(near, middle).otherwise(a), 4)).otherwise(F.coalesce(a, b)).alias("pe"),
        F.when(both, spread <= divergence).alias("ok"), (~both).alias("single_source"))


def valuation_tag(pe: Column, peer_median: Column, revenue_yoy: Column) -> Column:
    """cheap, fair or rich against the peers (or absolute bands without them); strong growth softens
    rich to fair."""
    r = pe / F.when(peer_median > 0, peer_median)
    base = (F.when(r.isNotNull(), F.when(r < 0.8, "cheap").when(r > 1.25, "rich").otherwise("fair"))
            .otherwise(F.when(pe < 15, "cheap").when(pe > 30, "rich").otherwise("fair")))
    growing = F.coalesce(revenue_yoy >= 0.20, F.lit(False))
    return F.when(pe > 0, F.when((base == "rich") & growing, "fair").otherwise(base))


def label_valuations(values: DataFrame, group: str) -> DataFrame:
    """Tag each name against the lower-middle P/E of its peer group."""
    peers = values.where(F.col("pe") > 0).groupBy(group).agg(lower_middle("pe").alias("peer_pe"))
    return values.join(peers, group, "left").withColumn(
        "tag", valuation_tag(F.col("pe"), F.col("peer_pe"), F.col("revenue_yoy")))
