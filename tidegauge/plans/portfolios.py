"""Queries over many portfolios: sizing, rebalancing, stress, schedules and the option screen."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import options
from tidegauge.functions.scalar import ratio, with_group
from tidegauge.operators import diversify, option_screen, signals, sizing
from tidegauge.operators.universe import sleeve_axis
from tidegauge.plans.prices import r6
from tidegauge.plans.registry import query, shared
from tidegauge.session import cut
from tidegauge.plans.themes import fx_rates, market_posture, static_scored


def sized_holdings(t):
    """Holdings with their name-level inputs. Those are put together as one small table first: its size
    is then known, so it is broadcast if it fits and the holdings keep their bucketing."""
    tilt = signals.momentum_tilt(F.col("mom_12m"), F.col("above_ma200"))
    names = t.quotes.select("ticker", "price", F.col("vol_1y").alias("vol"), tilt.alias("tilt")).join(
        signals.ticker_opportunity(t.theme_members, static_scored(t)), "ticker", "full_outer")
    return t.holdings.join(cut(names), "ticker", "left")


shared(
    sized="""SELECT h.* EXCLUDE (axis), CASE WHEN h.axis = 'diversifier' OR contains(lower(role), 'de-correlator') THEN 'diversifier' ELSE 'deep-tech' END AS axis,
      price, vol_1y AS vol, tilt, opportunity FROM holdings h LEFT JOIN tech USING (ticker) LEFT JOIN (SELECT ticker, tilt FROM name_scores) USING (ticker)
      LEFT JOIN ticker_opp USING (ticker) WHERE target_usd > 0""",
    risked="""SELECT *, CASE WHEN vol > 0 AND count(vol) OVER p >= 2 THEN least(1.15e0, greatest(0.85e0, exp(avg(ln(vol)) OVER p) / vol)) ELSE 1e0 END AS rf
      FROM sized WINDOW p AS (PARTITION BY portfolio_id)""",
    factors="""SELECT *, rf AS research_factor, CASE WHEN axis = 'diversifier' THEN rf ELSE rf * coalesce(least(1.3e0, greatest(0.7e0, 0.7e0 + 0.6e0 * (opportunity / 100))), 1e0)
      * CASE WHEN account <> 'ira' THEN 1e0 WHEN tilt = 'overweight' AND (SELECT posture FROM market_posture) = 'risk-on' THEN 1.15e0 WHEN tilt = 'underweight' THEN 0.85e0 ELSE 1e0 END END AS signal_factor FROM risked""",
)


def weights_sql(factor: str, total: str = "sum(target_usd) OVER cell", src: str = "factors") -> str:
    return f"""SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY portfolio_id, account, axis ORDER BY frac DESC, ticker) <= tot - sum(fl) OVER cell THEN 1 ELSE 0 END AS whole FROM (
      SELECT *, CAST(floor(tot * w) AS BIGINT) AS fl, tot * w - floor(tot * w) AS frac FROM (
      SELECT *, CAST(floor(round({total}, 6) + 0.5e0) AS BIGINT) AS tot, target_usd * {factor} / sum(target_usd * {factor}) OVER cell AS w, {factor} AS factor
      FROM {src} WINDOW cell AS (PARTITION BY portfolio_id, account, axis))) WINDOW cell AS (PARTITION BY portfolio_id, account, axis)"""


shared(
    research_targets=weights_sql("research_factor"),
    signal_targets=weights_sql("signal_factor"),
)


@query("WN21 SF8", f"SELECT portfolio_id, account, ticker, {r6('rf')} FROM risked")
def risk_factors(t):
    return sizing.risk_factors(sized_holdings(t)).select("portfolio_id", "account", "ticker", F.col("risk_factor").alias("rf"))


def weights_query(mode):
    return f"""SELECT portfolio_id, account, axis, ticker, target_usd AS base_usd, round(factor, 6) AS factor, round(w * 100, 6) AS target_weight,
CAST(whole AS BIGINT) AS target_usd FROM {mode}_targets"""


def targets(t, mode):
    return sizing.target_weights(sized_holdings(t), mode, market_posture(t))


@query("WN22 SF8", weights_query("research"))
def research_weights(t):
    return targets(t, "research").select("portfolio_id", "account", "axis", "ticker", "base_usd", "factor",
                                         (F.col("weight_in_cell") * 100).alias("target_weight"), "target_usd")


@query("WN22", weights_query("signal"))
def signal_weights(t):
    return targets(t, "signal").select("portfolio_id", "account", "axis", "ticker", "base_usd", "factor",
                                       (F.col("weight_in_cell") * 100).alias("target_weight"), "target_usd")


shared(plan_rows="""SELECT *, CASE WHEN blocked THEN 0 ELSE delta_usd END AS actioned_usd,
  CASE WHEN delta_usd > 0 THEN 'buy' WHEN blocked THEN 'hold (anchor - trim bar not met)' WHEN delta_usd < 0 AND account = 'ira' THEN 'trim (funds buys)'
   WHEN delta_usd < 0 THEN 'trim (high-conviction)' ELSE 'hold' END AS action FROM (
  SELECT portfolio_id, account, axis, ticker, round(w * 100, 6) AS target_weight, target_usd AS current_usd, CAST(whole AS BIGINT) AS target_usd,
   CAST(whole - target_usd AS BIGINT) AS delta_usd, whole - target_usd < 0 AND account = 'taxable' AND k.ok IS NULL AS blocked
  FROM signal_targets LEFT JOIN (SELECT portfolio_id, ticker, true AS ok FROM positions JOIN tech USING (ticker) WHERE price / cost_basis >= 2 AND forward_pe > 50) k USING (portfolio_id, ticker))""")


def plan_rows(t):
    ok = signals.trim_candidates(t.positions, t.quotes).select("portfolio_id", "ticker", F.lit(True).alias("trim_ok"))
    joined = targets(t, "signal").join(ok, ["portfolio_id", "ticker"], "left").withColumn(
        "current_usd", F.lit(None).cast("double"))
    return sizing.rebalance_rows(joined)


@query("WN23", "SELECT portfolio_id, account, axis, ticker, target_weight, current_usd, target_usd, delta_usd, CAST(actioned_usd AS BIGINT) AS actioned_usd, action FROM plan_rows")
def rebalance_plan(t):
    return plan_rows(t)


@query("WN23", """
WITH a AS (SELECT portfolio_id, account, sum(greatest(delta_usd, 0)) AS buy, sum(greatest(-actioned_usd, 0)) AS sell,
  sum(CASE WHEN blocked THEN -delta_usd ELSE 0 END) AS blocked FROM plan_rows GROUP BY 1, 2),
c AS (SELECT portfolio_id, account, sum(target_usd) AS cash FROM holdings WHERE tier = 'DRY' GROUP BY 1, 2)
SELECT portfolio_id, CAST(sum(buy) AS BIGINT) AS buy_usd, CAST(sum(sell) AS BIGINT) AS sell_usd, CAST(sum(buy) - sum(sell) AS BIGINT) AS net_usd,
 CAST(sum(blocked) AS BIGINT) AS blocked_trim_usd, CAST(sum(greatest(0, buy - sell - coalesce(cash, 0))) AS BIGINT) AS needs_new_cash_usd
FROM a LEFT JOIN c USING (portfolio_id, account) GROUP BY 1""")
def rebalance_funding(t):
    cash = t.holdings.where(F.col("tier") == "DRY").groupBy("portfolio_id", "account").agg(F.sum("target_usd").alias("cash_usd"))
    return sizing.rebalance_summary(plan_rows(t), cash)


@query("WN23 WN22", f"""
WITH x AS ({weights_sql('signal_factor', 'sum(current_usd) OVER cell', 'live_held')})
SELECT portfolio_id, account, axis, ticker, CAST(round(current_usd) AS BIGINT) AS current_usd, CAST(whole AS BIGINT) AS target_usd,
 CAST(round(whole - current_usd) AS BIGINT) AS delta_usd FROM x""")
def live_rebalance(t):
    usd = signals.position_usd(t.positions, t.quotes, t.securities, fx_rates(t)).where(F.col("usd").isNotNull()).select(
        "portfolio_id", "ticker", F.col("usd").alias("current_usd"))
    held = sized_holdings(t).join(usd, ["portfolio_id", "ticker"])
    # a name held in several accounts: its value is split by what each account wants of it
    held = with_group(held, ["portfolio_id", "ticker"], _wanted=F.sum("target_usd"))
    held = held.withColumn("current_usd", ratio(F.col("current_usd") * F.col("target_usd"), F.col("_wanted"))).drop("_wanted")
    out = sizing.target_weights(held, "research", total="current_usd").withColumn("trim_ok", F.lit(False))
    return sizing.rebalance_rows(out).select(
        "portfolio_id", "account", "axis", "ticker", "current_usd", "target_usd", "delta_usd")


shared(live_held="""SELECT * EXCLUDE (rf), CASE WHEN vol > 0 AND count(vol) OVER p >= 2 THEN least(1.15e0, greatest(0.85e0, exp(avg(ln(vol)) OVER p) / vol)) ELSE 1e0 END AS signal_factor
  FROM (SELECT s.*, c.usd * s.target_usd / sum(s.target_usd) OVER (PARTITION BY s.portfolio_id, s.ticker) AS current_usd, 1 AS rf FROM sized s JOIN usd_positions c ON c.portfolio_id = s.portfolio_id AND c.ticker = s.ticker WHERE c.usd IS NOT NULL) WINDOW p AS (PARTITION BY portfolio_id)""")


@query("WN24", """SELECT portfolio_id, account, ticker, coalesce(tilt, 'n/a') AS tilt, CASE WHEN account <> 'ira' THEN 0e0
  WHEN tilt = 'overweight' AND posture = 'risk-on' THEN 25e0 WHEN tilt = 'underweight' THEN -25e0 ELSE 0e0 END AS delta_pct,
 CASE WHEN account <> 'ira' THEN 'hold (taxable anchor)' WHEN tilt = 'overweight' AND posture = 'risk-on' THEN 'add' WHEN tilt = 'underweight' THEN 'trim' ELSE 'hold' END AS action FROM sized, market_posture""")
def tilt_deltas(t):
    return sizing.tilt_deltas(sized_holdings(t).where(F.col("target_usd") > 0), market_posture(t))


@query("WN25", """
WITH h AS (SELECT portfolio_id, ticker, sum(target_usd) AS target FROM holdings GROUP BY 1, 2),
v AS (SELECT portfolio_id, ticker, price * shares AS mv, target FROM positions JOIN tech USING (ticker) JOIN h USING (portfolio_id, ticker)),
w AS (SELECT portfolio_id, ticker, mv / sum(mv) OVER p AS w, target / sum(target) OVER p AS tw FROM v WINDOW p AS (PARTITION BY portfolio_id))
SELECT portfolio_id, ticker, round(w * 100, 6) AS weight, round(tw * 100, 6) AS target_weight, round((w / tw - 1) * 100, 6) AS drift, abs(w / tw - 1) > 0.25 AS flagged,
 CASE WHEN w / tw - 1 > 0.25 THEN 'trim' WHEN w / tw - 1 < -0.25 THEN 'add' ELSE 'hold' END AS action FROM w""")
def drift_flags(t):
    target = t.holdings.groupBy("portfolio_id", "ticker").agg(F.sum("target_usd").alias("target_usd"))
    return sizing.drift_flags(t.positions.join(t.quotes.select("ticker", "price"), "ticker").join(
        target, ["portfolio_id", "ticker"]))


# ---- funding and edits -------------------------------------------------------------------------------

shared(
    book="""SELECT portfolio_id, ticker, min(account) AS account, sum(target_usd) AS usd, CAST(sum(target_usd) AS BIGINT) AS target_usd,
      CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 5 = 0 OR CAST(substr(ticker, 2) AS BIGINT) % 10 = 3 THEN 'diversifier' ELSE 'deep-tech' END AS axis,
      CAST(sum(sum(target_usd)) OVER (PARTITION BY portfolio_id) AS BIGINT) AS sleeve_usd,
      floor(sum(target_usd) / sum(sum(target_usd)) OVER (PARTITION BY portfolio_id) * 10000 + 0.5e0) / 10000 AS weight FROM holdings GROUP BY portfolio_id, ticker""",
    wanted="""SELECT c_custkey AS portfolio_id, ticker, round(0.3e0 + (CAST(substr(ticker, 2) AS BIGINT) % 7) / 10e0, 6) AS conviction, vol_1y AS vol
      FROM customer JOIN theme_members ON theme = 'N' || c_nationkey LEFT JOIN tech USING (ticker)""",
    funded="""SELECT portfolio_id, ticker, conviction, budget, existing, floor((budget * raw / sum(raw) OVER (PARTITION BY portfolio_id)) * 10000 + 0.5e0) / 10000 AS weight FROM (
      SELECT w.*, coalesce(existing, 0) AS existing, greatest(0, round(0.35e0 - coalesce(existing, 0), 6)) AS budget, conviction / greatest(coalesce(vol, 0.25e0), 0.01e0) AS raw FROM (
        SELECT w.* FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM book b WHERE b.portfolio_id = w.portfolio_id AND b.ticker = w.ticker)
        QUALIFY row_number() OVER (PARTITION BY w.portfolio_id ORDER BY conviction DESC, w.ticker) <= 3) w
      LEFT JOIN (SELECT portfolio_id, sum(CASE WHEN axis = 'diversifier' THEN weight ELSE 0 END) AS existing FROM book GROUP BY 1) e USING (portfolio_id))""",
)


def book(t):
    """One row per portfolio and ticker with its weight in the whole portfolio."""
    rows = t.holdings.groupBy("portfolio_id", "ticker").agg(
        F.min("account").alias("account"), F.sum("target_usd").alias("target_usd"),
        F.min("axis").alias("axis"), F.min("role").alias("role"))
    rows = with_group(rows, ["portfolio_id"], sleeve_usd=F.sum("target_usd"))
    weight = F.floor(F.col("target_usd") / F.col("sleeve_usd") * 10000 + 0.5) / F.lit(10000.0)
    return rows.withColumn("weight", weight).withColumn(
        "is_diversifier", sleeve_axis(F.col("axis"), F.col("role")) == "diversifier")


def wanted(t, most_new=3):
    """Names that a portfolio may want: the best of its theme. A portfolio looks no further down the theme's ranking than
    the names it wants beside those of the theme it holds already, so the pairs grow with the holdings."""
    level = F.round(0.3 + (F.expr("substr(ticker, 2)").cast("bigint") % 7) / 10.0, 6)
    customers = t.read("customer").select(
        F.col("c_custkey").alias("portfolio_id"), F.concat(F.lit("N"), "c_nationkey").alias("theme"))
    held = t.holdings.select("portfolio_id", "ticker").distinct().join(t.theme_members, "ticker").groupBy("portfolio_id", "theme").agg(F.count("*").alias("n"))
    ranks = F.sequence(F.lit(1), (most_new + F.coalesce("n", F.lit(0))).cast("int"))
    seen = customers.join(held, ["portfolio_id", "theme"], "left").select("portfolio_id", "theme", F.explode(ranks).alias("_rank"))
    order = Window.partitionBy("theme").orderBy(F.desc("_level"), "ticker")
    best = t.theme_members.withColumn("_level", level).withColumn("_rank", F.row_number().over(order)).drop("_level")
    return seen.join(best, ["theme", "_rank"]).join(
        t.quotes.select("ticker", F.col("vol_1y").alias("vol")), "ticker", "left").select(
        "portfolio_id", "ticker", level.alias("conviction"), "vol")


@query("WN26", f"SELECT portfolio_id, ticker, {r6('conviction', 'budget', 'existing', 'weight')} FROM funded WHERE weight > 0")
def sleeve_funding(t):
    return diversify.fund_sleeve(wanted(t), book(t), sleeve_pct=0.35, max_names=3)


@query("WN26", """
WITH f AS (SELECT * FROM funded WHERE weight > 0),
sc AS (SELECT portfolio_id, floor(((1 - max(existing) - sum(weight)) / (1 - max(existing))) * 10000 + 0.5e0) / 10000 AS scale FROM f GROUP BY 1)
SELECT portfolio_id, ticker, round(w, 6) AS weight, target_usd FROM (
SELECT b.portfolio_id, b.ticker, CASE WHEN scale IS NOT NULL AND axis <> 'diversifier' THEN floor((weight * scale) * 10000 + 0.5e0) / 10000 ELSE weight END AS w,
 CASE WHEN scale IS NOT NULL AND axis <> 'diversifier' THEN CAST(floor(floor((weight * scale) * 10000 + 0.5e0) / 10000 * sleeve_usd + 0.5e0) AS BIGINT) ELSE target_usd END AS target_usd FROM book b LEFT JOIN sc USING (portfolio_id)
UNION ALL SELECT f.portfolio_id, f.ticker, f.weight, CAST(floor(f.weight * s.sleeve_usd + 0.5e0) AS BIGINT) FROM f LEFT JOIN (SELECT DISTINCT portfolio_id, sleeve_usd FROM book) s USING (portfolio_id))""")
def funded_plan(t):
    holdings = book(t)
    return diversify.apply_funding(holdings, diversify.fund_sleeve(wanted(t), holdings, sleeve_pct=0.35, max_names=3))


@query("WN27", """
WITH e AS (SELECT b.*, CASE CAST(substr(ticker, 2) AS BIGINT) % 20 WHEN 1 THEN 'cut' WHEN 2 THEN 'trim' END AS edit FROM book b),
w AS (SELECT *, CASE edit WHEN 'cut' THEN 0 WHEN 'trim' THEN floor((weight * (2e0 / 3e0)) * 10000 + 0.5e0) / 10000 ELSE weight END AS ew FROM e),
g AS (SELECT *, bool_or(edit IS NOT NULL AND weight > 0) OVER p AS hit, round(sum(CASE WHEN axis = 'diversifier' THEN weight ELSE 0 END) OVER p, 6) AS bd,
 round(sum(CASE WHEN axis <> 'diversifier' THEN weight ELSE 0 END) OVER p, 6) AS bb, round(sum(CASE WHEN axis = 'diversifier' THEN ew ELSE 0 END) OVER p, 6) AS ad,
 round(sum(CASE WHEN axis <> 'diversifier' THEN ew ELSE 0 END) OVER p, 6) AS ab FROM w WINDOW p AS (PARTITION BY portfolio_id)),
n AS (SELECT *, hit AND ad + ab > 0 AS applies, CASE WHEN (bb = 0 OR ab > 0) AND (bd = 0 OR ad > 0)
  THEN floor((ew * coalesce(CASE WHEN axis = 'diversifier' THEN bd / nullif(ad, 0) ELSE bb / nullif(ab, 0) END, 1)) * 10000 + 0.5e0) / 10000 ELSE floor((ew / (ad + ab)) * 10000 + 0.5e0) / 10000 END AS nw FROM g)
SELECT portfolio_id, account, ticker, round(CASE WHEN applies THEN nw ELSE weight END, 6) AS weight,
 CASE WHEN applies THEN CAST(floor(nw * sleeve_usd + 0.5e0) AS BIGINT) ELSE target_usd END AS target_usd FROM n WHERE NOT applies OR ew > 0""")
def catalyst_edits(t):
    k = F.expr("substr(ticker, 2)").cast("bigint") % 20
    edits = t.securities.select("ticker", F.when(k == 1, "cut").when(k == 2, "trim").alias("edit")).where(F.col("edit").isNotNull())
    return sizing.cut_or_trim(book(t), edits)


SHOCKS = [*sizing.SCENARIOS[:3], {"id": "targeted", "market": 0.0, "beta": 1.0, "targeted": {"S1": -0.5, "S2": -0.5}}]


@query("JN5", """
SELECT portfolio_id, scenario, round(before, 6) AS before, round(after, 6) AS after, round(after / before - 1, 6) AS drawdown, after / before - 1 <= -0.35 AS breaches_35 FROM (
SELECT portfolio_id, s.scenario, sum(usd) AS before, sum(usd * (1 + coalesce(CASE WHEN s.scenario = 'targeted' AND ticker IN ('S1', 'S2') THEN -0.5e0 END,
  s.market * CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 4 = 0 THEN 1.5e0 ELSE s.beta END))) AS after
FROM usd_positions, (VALUES ('digestion', -0.35e0, 1.2e0), ('rate-shock', -0.25e0, 1.3e0), ('recession', -0.30e0, 1.1e0), ('targeted', 0e0, 1e0)) s(scenario, market, beta)
WHERE usd > 0 GROUP BY 1, 2)""")
def scenario_stress(t):
    beta = F.when(F.expr("substr(ticker, 2)").cast("bigint") % 4 == 0, 1.5)
    valued = signals.position_usd(t.positions, t.quotes, t.securities, fx_rates(t)).withColumn("beta", beta)
    return sizing.stress(valued, SHOCKS)


@query("JN6", """
SELECT portfolio_id, ticker, tier, CAST(target AS BIGINT) AS target, CAST(floor(shares * cost_basis + 0.5e0) AS BIGINT) AS deployed,
 least(100, CAST(floor(shares * cost_basis * 100 / target + 0.5e0) AS BIGINT)) AS pct
FROM (SELECT portfolio_id, ticker, min(tier) AS tier, sum(target_usd) AS target FROM holdings GROUP BY 1, 2) JOIN positions USING (portfolio_id, ticker)""")
def dca_progress(t):
    return sizing.dca_progress(t.holdings, t.positions)


@query("SF11", """
WITH s AS (SELECT *, CASE tier WHEN 'B' THEN 3 WHEN 'C' THEN 9 ELSE 0 END AS months, CASE WHEN tier IN ('A', 'D') THEN 1e0 WHEN tier = 'B' THEN 0.5e0 WHEN tier = 'C' THEN 0.25e0 ELSE 0e0 END AS f FROM holdings),
x AS (SELECT *, CAST(floor(target_usd * f + 0.5e0) AS BIGINT) AS now_, CASE WHEN months > 0 THEN CAST(floor(target_usd * (1 - f) + 0.5e0) AS BIGINT) ELSE 0 END AS later, unnest(range(0, months + 1)) AS month FROM s)
SELECT portfolio_id, account, ticker, month, CASE WHEN month = 0 THEN now_ WHEN month < months THEN later // months ELSE later - (later // months) * (months - 1) END AS amount FROM x""")
def dca_schedule(t):
    return sizing.dca_schedule(t.holdings).select(
        "portfolio_id", "account", "ticker", F.col("month").cast("bigint").alias("month"), "amount")


# ---- options -----------------------------------------------------------------------------------------

CDF = """(CASE WHEN {x} >= 0 THEN 1 - 0.3989422804014327e0 * exp(-{x} * {x} / 2) * (0.319381530e0 * k{n} - 0.356563782e0 * k{n} ** 2 + 1.781477937e0 * k{n} ** 3 - 1.821255978e0 * k{n} ** 4 + 1.330274429e0 * k{n} ** 5)
 ELSE 0.3989422804014327e0 * exp(-{x} * {x} / 2) * (0.319381530e0 * k{n} - 0.356563782e0 * k{n} ** 2 + 1.781477937e0 * k{n} ** 3 - 1.821255978e0 * k{n} ** 4 + 1.330274429e0 * k{n} ** 5) END)"""


def bs_sql(src: str, vol: str, out: str) -> str:
    """Price each row of src at volatility `vol`; put by parity of the normal distribution."""
    n1, n2 = CDF.format(x="d1", n="1"), CDF.format(x="d2", n="2")
    return f"""SELECT * EXCLUDE (d1, d2, k1, k2), CASE WHEN kind = 'call' THEN spot * {n1} - strike * exp(-0.04e0 * yrs) * {n2}
      ELSE strike * exp(-0.04e0 * yrs) * (1 - {n2}) - spot * (1 - {n1}) END AS {out} FROM (
      SELECT *, 1 / (1 + 0.2316419e0 * abs(d1)) AS k1, 1 / (1 + 0.2316419e0 * abs(d2)) AS k2 FROM (
      SELECT *, d1 - {vol} * sqrt(yrs) AS d2 FROM (SELECT *, (ln(spot / strike) + (0.04e0 + {vol} * {vol} / 2) * yrs) / ({vol} * sqrt(yrs)) AS d1 FROM {src})))"""


shared(
    contracts="""SELECT p_partkey * 2 + CASE kind WHEN 'put' THEN 1 ELSE 0 END AS contract, 'S' || (p_partkey % (SELECT count(*) FROM supplier)) AS underlying, kind, p_retailprice AS spot,
      p_retailprice * (0.8e0 + 0.01e0 * (p_size % 40)) AS strike, 20 + p_size * 7 AS days, (20 + p_size * 7) / 365e0 AS yrs, 0.2e0 + 0.01e0 * (p_size % 30) AS true_vol
      FROM part, (VALUES ('call'), ('put')) k(kind)""",
    chain="SELECT c.* EXCLUDE (m), floor(m * 100 + 0.2871e0) / 100 AS market, vol_1y / 100 AS ref_vol FROM (" + bs_sql("contracts", "true_vol", "m") + ") c LEFT JOIN tech ON ticker = underlying",
)


def option_chain(t):
    from tidegauge.plans.tables import cents

    suppliers = t.read("supplier").agg(F.count("*")).scalar()
    kinds = F.explode(F.array(F.lit("call"), F.lit("put")))
    rows = t.read("part").withColumn("kind", kinds).select(
        (F.col("p_partkey") * 2 + (F.col("kind") == "put").cast("int")).alias("contract"),
        F.concat(F.lit("S"), F.col("p_partkey") % suppliers).alias("underlying"), "kind",
        F.col("p_retailprice").alias("spot"),
        (F.col("p_retailprice") * (0.8 + 0.01 * (F.col("p_size") % 40))).alias("strike"),
        (20 + F.col("p_size") * 7).alias("days"), (0.2 + 0.01 * (F.col("p_size") % 30)).alias("true_vol"))
    quoted = options.price(F.col("kind"), F.col("spot"), F.col("strike"), F.col("days") / 365.0, F.col("true_vol"))
    vols = t.quotes.select(F.col("ticker").alias("underlying"), (F.col("vol_1y") / 100).alias("ref_vol"))
    return rows.withColumn("market", cents(quoted)).join(vols, "underlying", "left")


SOLVE = "WITH RECURSIVE b AS (SELECT *, 1e-4 AS lo, 5e0 AS hi, 0 AS i FROM solvable UNION ALL SELECT * EXCLUDE (lo, hi, i, m, p), CASE WHEN lo = hi THEN lo WHEN abs(p - market) < 1e-6 THEN m WHEN p > market THEN lo ELSE m END, " \
    "CASE WHEN lo = hi THEN hi WHEN abs(p - market) < 1e-6 THEN m WHEN p > market THEN m ELSE hi END, i + 1 FROM (" + bs_sql("(SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 100)", "m", "p") + ") ),\n" \
    "solved AS (SELECT contract, (lo + hi) / 2 AS iv FROM b WHERE i = 100),\n" \
    "fair AS (" + bs_sql("(SELECT * FROM chain WHERE ref_vol > 0)", "ref_vol", "fv") + "),\n"
shared(solvable="""SELECT * FROM chain WHERE market > 0 AND market >= greatest(0, CASE kind WHEN 'put' THEN strike * exp(-0.04e0 * yrs) - spot ELSE spot - strike * exp(-0.04e0 * yrs) END) - 1e-6""")


@query("SF9", SOLVE + """
r AS (SELECT c.contract, c.underlying, c.kind, iv, iv / c.ref_vol AS q, fv, c.market - fv AS edge FROM chain c LEFT JOIN solved USING (contract) LEFT JOIN fair USING (contract))
SELECT contract, underlying, kind, round(iv, 6) AS implied_vol, round(q, 6) AS iv_to_realized, round(fv, 6) AS fair_value, round(edge, 6) AS edge,
 CASE WHEN q IS NULL THEN 'unknown' WHEN q < 0.95 THEN 'cheap' WHEN q <= 1.35 THEN 'fair' ELSE 'rich' END AS verdict FROM r""")
def option_screen_rows(t):
    return option_screen.evaluate(option_chain(t)).select(
        "contract", "underlying", "kind", "implied_vol", "iv_to_realized", "fair_value", "edge", "verdict")


N1, N2 = (CDF.format(x=f"d{n}", n=n) for n in "12")
DENSITY = "0.3989422804014327e0 * exp(-d1 * d1 / 2)"


@query("SF9", f"""
WITH s AS (SELECT *, 1 / (1 + 0.2316419e0 * abs(d1)) AS k1, 1 / (1 + 0.2316419e0 * abs(d2)) AS k2 FROM (SELECT *, d1 - v * sqrt(yrs) AS d2 FROM (
 SELECT *, (ln(spot / strike) + (0.04e0 + v * v / 2) * yrs) / (v * sqrt(yrs)) AS d1 FROM (SELECT *, true_vol AS v FROM contracts))))
SELECT contract, round(CASE kind WHEN 'call' THEN {N1} ELSE {N1} - 1 END, 6) AS delta, round({DENSITY} / (spot * v * sqrt(yrs)), 6) AS gamma, round(spot * {DENSITY} * sqrt(yrs) / 100, 6) AS vega,
 round((-spot * {DENSITY} * v / (2 * sqrt(yrs)) + CASE kind WHEN 'call' THEN -0.04e0 * strike * exp(-0.04e0 * yrs) * {N2} ELSE 0.04e0 * strike * exp(-0.04e0 * yrs) * (1 - {N2}) END) / 365, 6) AS theta,
 CASE WHEN vix > 0 THEN CASE WHEN vix >= 22 THEN 'rich' WHEN vix <= 14 THEN 'cheap' ELSE 'normal' END END AS band FROM (SELECT *, contract % 40 AS vix FROM s)""")
def option_greeks(t):
    """Greeks at the quoted volatility, and the band of the market's volatility index on the day."""
    from tidegauge.functions.options import greeks, volatility_band

    rows = option_chain(t)
    return rows.select("contract", *[c.alias(n) for n, c in greeks(
        F.col("kind"), F.col("spot"), F.col("strike"), F.col("days") / 365.0, F.col("true_vol")).items()],
        volatility_band(F.col("contract") % 40).alias("band"))


@query("SF9", SOLVE + """
r AS (SELECT c.underlying, iv, iv / c.ref_vol AS q FROM chain c LEFT JOIN solved USING (contract))
SELECT underlying, count(*) AS contracts, count(iv) AS solved, round(avg(iv), 6) AS mean_iv, round(avg(q), 6) AS mean_ratio, count(*) FILTER (q < 0.95) AS cheap,
 count(*) FILTER (q BETWEEN 0.95 AND 1.35) AS fair, count(*) FILTER (q > 1.35) AS rich FROM r GROUP BY 1""")
def option_screen_summary(t):
    return option_screen.summarize(option_screen.evaluate(option_chain(t)))


@query("TK5", """
SELECT underlying, round(avg(iv), 6) AS atm_iv FROM (SELECT underlying, kind, true_vol AS iv FROM contracts
 QUALIFY row_number() OVER (PARTITION BY underlying, kind ORDER BY abs(strike - spot), strike, contract) = 1) GROUP BY 1""")
def at_the_money_vol(t):
    return option_screen.at_the_money(option_chain(t).withColumn("iv", F.col("true_vol")))
