"""Queries for name, theme and portfolio signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import signals, timing, universe
from tidegauge.operators.diversify import gate_passes
from tidegauge.plans.prices import r6
from tidegauge.plans.registry import query, shared


def case(col: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {default} END"


shared(
    themes="""SELECT 'N' || n_nationkey AS theme, r_name AS sector, n_name AS scarcity,
      ['now', '2027', '2028-29', '2030+', 'physics-floor'][n_nationkey % 5 + 1] AS bind_window,
      ['low', 'medium', 'high', 'crowded'][n_nationkey % 4 + 1] AS priced_in,
      ['low', 'medium', 'high', 'very-high'][(n_nationkey // 2) % 4 + 1] AS durability,
      ['low', 'medium', 'high'][n_nationkey % 3 + 1] AS substitution_risk, n_nationkey % 2 = 0 AS non_consensus,
      CASE WHEN n_nationkey % 6 = 5 THEN 'diversifier' ELSE 'deep-tech' END AS axis,
      'supply of ' || n_name || ' recovers' AS kill_condition,
      CASE n_nationkey % 4 WHEN 0 THEN '2001' WHEN 1 THEN '2001-06' WHEN 2 THEN '2001-03-15' ELSE 'someday' END AS kill_by
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    theme_members="""SELECT 'N' || s_nationkey AS theme, 'S' || s_suppkey AS ticker FROM supplier
      UNION ALL SELECT 'N' || ((s_nationkey + 1) % 25), 'S' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0""",
    name_scores="""SELECT ticker, ytd, pct_off_high, mom_1m, mom_12m, above_ma200,
      CASE WHEN ytd IS NOT NULL THEN CAST(floor(least(100, greatest(0, least(60, greatest(0, ytd * 100))
        + least(40, greatest(0, 40 * (1 + pct_off_high / 0.25e0))))) + 0.5e0) AS BIGINT) END AS crowding,
      floor(least(1, least(1, greatest(0, -pct_off_high) / 0.4e0) * 0.6e0 + CASE WHEN above_ma200 = false THEN 0.2e0 ELSE 0 END
        + CASE WHEN mom_1m < 0 THEN least(1, -mom_1m / 0.2e0) * 0.2e0 ELSE 0 END) * 1000 + 0.5e0) / 1000 AS dislocation,
      CASE WHEN mom_12m IS NULL THEN 'n/a' WHEN mom_12m > 0 AND above_ma200 THEN 'overweight'
        WHEN mom_12m < 0 AND above_ma200 = false THEN 'underweight' ELSE 'neutral' END AS tilt FROM tech""",
    theme_crowding="""SELECT theme, avg(crowding) AS crowding, count(crowding) AS crowding_n FROM theme_members JOIN name_scores USING (ticker) GROUP BY 1""",
    scored=f"""SELECT *, CAST(floor(least(100, 100 * gate * quality * bonus) + 0.5e0) AS BIGINT) AS score FROM (
      SELECT t.*, crowding, {case('priced_in', signals.PRICED_GATE, '0.5e0')} AS static_gate,
      CASE WHEN crowding IS NOT NULL THEN least(1, greatest(0, 1 - crowding / 100)) END AS live_gate,
      CASE WHEN crowding IS NULL THEN {case('priced_in', signals.PRICED_GATE, '0.5e0')}
        ELSE 0.6e0 * {case('priced_in', signals.PRICED_GATE, '0.5e0')} + 0.4e0 * least(1, greatest(0, 1 - crowding / 100)) END AS gate,
      0.40e0 * {case('bind_window', signals.BIND_PROXIMITY, '0.5e0')} + 0.35e0 * {case('durability', signals.DURABILITY, '0.5e0')}
        + 0.25e0 * {case('substitution_risk', signals.DEFENSIBILITY, '0.5e0')} AS quality,
      CASE WHEN non_consensus THEN 1.15e0 ELSE 1e0 END AS bonus FROM themes t LEFT JOIN theme_crowding USING (theme))""",
    etf_mom="SELECT avg(mom_1m) AS m FROM tech JOIN securities USING (ticker) WHERE type = 'etf'",
    theme_rs="""SELECT theme, floor((avg(mom_1m) - (SELECT m FROM etf_mom)) * 10000 + 0.5e0) / 10000 AS rs
      FROM theme_members JOIN tech USING (ticker) WHERE mom_1m IS NOT NULL GROUP BY 1""",
)


def name_crowding(t):
    return t.quotes.select("ticker", signals.crowding(F.col("ytd"), F.col("pct_off_high")).alias("crowding"))


def theme_crowd(t):
    return signals.member_mean(t.theme_members, name_crowding(t), "crowding", "crowding")


def scored(t):
    return signals.opportunity(t.themes.join(theme_crowd(t).select("theme", "crowding"), "theme", "left"))


def static_scored(t):
    """Thesis-only scores: no live prices involved."""
    return signals.opportunity(t.themes.withColumn("crowding", F.lit(None).cast("double")))


def etf_momentum(t):
    etfs = t.quotes.join(t.securities.where(F.col("type") == "etf").select("ticker"), "ticker", "left_semi")
    return etfs.agg(F.avg("mom_1m")).scalar()


def theme_strength(t):
    return signals.relative_strength(t.theme_members, t.quotes, etf_momentum(t))


@query("PR6 PR7 PR11", "SELECT ticker, crowding, round(dislocation, 6) AS dislocation, tilt FROM name_scores")
def name_signals(t):
    return t.quotes.select(
        "ticker", signals.crowding(F.col("ytd"), F.col("pct_off_high")).alias("crowding"),
        signals.dislocation(F.col("pct_off_high"), F.col("mom_1m"), F.col("above_ma200")).alias("dislocation"),
        signals.momentum_tilt(F.col("mom_12m"), F.col("above_ma200")).alias("tilt"))


@query("AG12", "SELECT theme, round(crowding, 6) AS crowding, crowding_n FROM theme_crowding")
def theme_crowding(t):
    return theme_crowd(t)


@query("PR8 TK1", f"SELECT theme, scarcity, sector, score, {r6('gate', 'static_gate', 'live_gate', 'quality')} FROM scored WHERE axis <> 'diversifier'")
def opportunity_ranking(t):
    return signals.rank_opportunities(scored(t)).select(
        "theme", "scarcity", "sector", "score", "gate", "static_gate", "live_gate", "quality")


@query("PR12 AG10", """SELECT theme, priced_in, round(rs, 6) AS rs, CASE WHEN priced_in IN ('high', 'crowded') AND rs <= -0.03e0 THEN 'de-rating'
 WHEN priced_in IN ('low', 'medium') AND rs >= 0.03e0 THEN 'inflecting' ELSE 'none' END AS flag FROM themes LEFT JOIN theme_rs USING (theme)""")
def derating_flags(t):
    return t.themes.join(theme_strength(t), "theme", "left").select(
        "theme", "priced_in", "rs", signals.derating_flag(F.col("priced_in"), F.col("rs")).alias("flag"))


shared(ticker_rs="SELECT ticker, floor(avg(rs) * 10000 + 0.5e0) / 10000 AS rel_strength FROM theme_members JOIN theme_rs USING (theme) GROUP BY 1")


@query("JN2", "SELECT ticker, round(rel_strength, 6) AS rel_strength FROM ticker_rs")
def ticker_strength(t):
    return signals.ticker_strength(t.theme_members, theme_strength(t))


shared(ticker_opp="""SELECT ticker, max(least(100, 100 * (floor(static_gate * 100 + 0.5e0) / 100) * (floor(quality * 100 + 0.5e0) / 100) * bonus)) AS opportunity
FROM theme_members JOIN scored USING (theme) GROUP BY 1""")


@query("JN3", "SELECT ticker, round(opportunity, 6) AS opportunity FROM ticker_opp")
def ticker_opportunity(t):
    return signals.ticker_opportunity(t.theme_members, static_scored(t))


shared(entry_in="""SELECT ticker, -pct_off_high AS off_high, above_ma200, mom_12m, mom_1m, rel_strength,
  CASE CAST(substr(ticker, 2) AS BIGINT) % 4 WHEN 0 THEN 'cheap' WHEN 1 THEN 'rich' WHEN 2 THEN 'fair' END AS val_tag
  FROM tech LEFT JOIN ticker_rs USING (ticker)""",
    entry_legs="""SELECT *, least(1, greatest(0, off_high / 0.25e0)) * CASE WHEN off_high > 0.45e0 AND above_ma200 = false THEN 0.4e0 ELSE 1e0 END AS l1,
  CASE above_ma200 WHEN true THEN 0.55e0 WHEN false THEN 0.2e0 END AS l2,
  CASE WHEN mom_12m IS NULL THEN NULL ELSE (CASE WHEN mom_12m <= 0.4e0 THEN least(1, greatest(0, 0.6e0 + mom_12m)) ELSE least(1, greatest(0, 1 - (mom_12m - 0.4e0))) END)
    * CASE WHEN mom_1m > 0.15e0 THEN 0.7e0 ELSE 1e0 END END AS l3,
  CASE WHEN rel_strength IS NOT NULL THEN least(1, greatest(0, 0.5e0 + rel_strength / 2)) END AS l4,
  CASE val_tag WHEN 'cheap' THEN 0.9e0 WHEN 'rich' THEN 0.2e0 WHEN 'fair' THEN 0.55e0 END AS l5 FROM entry_in""",
    entry_scores="""SELECT *, CASE WHEN score IS NULL THEN 'n/a' WHEN score >= 66 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'stretched' END AS label FROM (
  SELECT *, CAST(floor(100 * (coalesce(0.22e0 * l1, 0) + coalesce(0.20e0 * l2, 0) + coalesce(0.20e0 * l3, 0) + coalesce(0.18e0 * l4, 0) + coalesce(0.20e0 * l5, 0))
    / (CASE WHEN l1 IS NULL THEN 0 ELSE 0.22e0 END + CASE WHEN l2 IS NULL THEN 0 ELSE 0.20e0 END + CASE WHEN l3 IS NULL THEN 0 ELSE 0.20e0 END
     + CASE WHEN l4 IS NULL THEN 0 ELSE 0.18e0 END + CASE WHEN l5 IS NULL THEN 0 ELSE 0.20e0 END) + 0.5e0) AS BIGINT) AS score FROM entry_legs)""",
)


@query("PR9 PR10", """SELECT ticker, score, label, array_to_string(list_filter([
  CASE WHEN off_high IS NOT NULL THEN CAST(CAST(floor(off_high * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '% off high' END,
  CASE above_ma200 WHEN true THEN 'above 200-DMA' WHEN false THEN 'below 200-DMA' END,
  CASE WHEN mom_12m IS NOT NULL THEN '12m ' || CASE WHEN mom_12m >= 0 THEN '+' ELSE '' END || CAST(CAST(floor(mom_12m * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '%'
    || CASE WHEN mom_1m > 0.15e0 THEN ' (just ran up)' WHEN mom_12m > 1 THEN ' (extended)' ELSE '' END END,
  CASE WHEN rel_strength > 0.05e0 THEN 'inflecting vs complex' WHEN rel_strength < -0.05e0 THEN 'de-rating vs complex' WHEN rel_strength IS NOT NULL THEN 'neutral vs complex' END,
  val_tag], lambda x: x IS NOT NULL), '; ') AS reasons,
  CAST(floor(10000 * CASE label WHEN 'fair' THEN 0.6e0 WHEN 'stretched' THEN 0.34e0 ELSE 1e0 END + 0.5e0) AS BIGINT) AS now_usd,
  10000 - CAST(floor(10000 * CASE label WHEN 'fair' THEN 0.6e0 WHEN 'stretched' THEN 0.34e0 ELSE 1e0 END + 0.5e0) AS BIGINT) AS later_usd FROM entry_scores""")
def entry_quality(t):
    k = F.expr("substr(ticker, 2)").cast("bigint") % 4
    inputs = t.quotes.join(signals.ticker_strength(t.theme_members, theme_strength(t)), "ticker", "left").withColumns({
        "off_high": -F.col("pct_off_high"),
        "val_tag": F.when(k == 0, "cheap").when(k == 1, "rich").when(k == 2, "fair")})
    now, later = signals.stage_buy(F.col("label"), F.lit(10000))
    return signals.entry_quality(inputs).select(
        "ticker", "score", "label", F.array_join("reasons", "; ").alias("reasons"),
        now.alias("now_usd"), later.alias("later_usd"))


shared(
    flow="""SELECT s.theme, dislocation, coalesce(n, 0) AS n, 'selling' AS window_, CASE WHEN n > 0 THEN score >= 55 END AS intact,
      CASE WHEN n >= 2 AND dislocation >= 0.5 AND score >= 55 THEN 'accumulate' WHEN n >= 2 AND dislocation >= 0.5 THEN 'broken' ELSE 'none' END AS flag
      FROM scored s LEFT JOIN (SELECT theme, floor(avg(dislocation) * 1000 + 0.5e0) / 1000 AS dislocation, count(dislocation) AS n
        FROM theme_members JOIN name_scores USING (ticker) GROUP BY 1) USING (theme)""",
    market_posture="""SELECT CASE WHEN trend IS NULL THEN 'unknown' WHEN crash_off THEN 'defensive' WHEN trend THEN 'risk-on' WHEN thrust THEN 'neutral' ELSE 'defensive' END AS posture FROM (
      SELECT CASE WHEN bar >= 211 THEN close > s200 END AS trend, CASE WHEN bar >= 211 THEN close / start - 1 < 0 AND vol60 > 0.25 END AS crash_off, close > s20 AND s20 > before AS thrust, d FROM (
      SELECT *, lag(s20, 10) OVER (ORDER BY d) AS before, stddev_samp(lr) OVER (ORDER BY d ROWS 59 PRECEDING) * sqrt(252) AS vol60 FROM (
      SELECT d, close, row_number() OVER w AS bar, ln(close / lag(close) OVER w) AS lr, coalesce(lag(close, 252) OVER w, first_value(close) OVER w) AS start,
       avg(close) OVER (ORDER BY d ROWS 199 PRECEDING) AS s200, avg(close) OVER (ORDER BY d ROWS 19 PRECEDING) AS s20 FROM market_bars WINDOW w AS (ORDER BY d)))
      ORDER BY d DESC LIMIT 1)""",
)


def market_posture(t):
    state = timing.ladder_state(timing.latest(timing.signals(t.market_bars)).withColumn("stress", F.lit(False)))
    return state.select("posture").scalar()


@query("AG11 PR13 PR15", """SELECT theme, round(dislocation, 6) AS dislocation, n, window_ AS season, intact, flag,
  CASE WHEN flag = 'accumulate' THEN posture = 'defensive' END AS subordinate_to_timing,
  CASE WHEN flag = 'accumulate' THEN CASE WHEN posture = 'defensive' THEN 'deploy on trigger' ELSE 'accumulate' END END AS guidance
FROM flow, market_posture""")
def forced_flow(t):
    flow = signals.forced_flow(t.theme_members, t.quotes, scored(t), t.scan_date)
    return signals.subordinate_to_timing(flow, market_posture(t), F.lit(False)).withColumnRenamed("window", "season")


@query("PR15", """SELECT ticker, year(d) AS y, CASE WHEN month(d) IN (11, 12) THEN 'selling' WHEN month(d) = 1 THEN 'rebound' END AS season, count(*) AS bars
FROM bars WHERE month(d) IN (11, 12, 1) GROUP BY 1, 2, 3""")
def tax_loss_seasons(t):
    season = signals.tax_loss_window(F.col("d"))
    return t.bars.groupBy("ticker", F.year("d").cast("bigint").alias("y"), season.alias("season")).agg(
        F.count("*").alias("bars")).where(F.col("season").isNotNull())


@query("PR14", """SELECT ticker, CASE WHEN NOT dis THEN 'none' WHEN turns <> '' THEN 'open' ELSE 'wait' END AS entry, CASE WHEN dis THEN turns ELSE '' END AS triggers FROM (
 SELECT s.ticker, dislocation >= 0.5 AS dis, concat_ws(', ', CASE WHEN pct_off_high <= -0.9 THEN 'drawdown trigger' END,
   CASE WHEN rule IN ('trend', 'thrust') THEN 'trend re-confirmed' END, CASE WHEN rule = 'thrust' THEN 'fast re-entry' END) AS turns
 FROM (SELECT *, CASE WHEN trend IS NULL THEN NULL WHEN crash_off THEN 'crash' WHEN trend THEN 'trend' WHEN thrust THEN 'thrust' ELSE 'cash' END AS rule FROM sig_last) s
 JOIN name_scores USING (ticker))""")
def dislocation_entry(t):
    state = timing.ladder_state(timing.latest(timing.signals(t.bars)).withColumn("stress", F.lit(None).cast("boolean")))
    dis = signals.dislocation(F.col("pct_off_high"), F.col("mom_1m"), F.col("above_ma200"))
    window, turns = signals.entry_window(dis >= 0.5, F.col("pct_off_high") <= -0.9, F.col("state"), F.col("fast_reentry"))
    return t.quotes.join(state.select("ticker", "state", "fast_reentry"), "ticker").select(
        "ticker", window.alias("entry"), F.array_join(turns, ", ").alias("triggers"))


shared(news="""SELECT page_id AS news_id, 'N' || (page_id % 25) AS theme, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  url AS link, DATE '2001-01-01' + CAST(page_id % 300 AS INTEGER) AS date FROM pages""")


@query("PR16", """SELECT theme, CAST(floor(100 * CASE WHEN mom IS NULL THEN least(1, coalesce(n, 0) / 5e0)
  ELSE (least(1, coalesce(n, 0) / 5e0) + least(1, greatest(0, 0.5e0 + mom * 5))) / 2 END + 0.5e0) AS BIGINT) AS heat,
  round(mom - (SELECT m FROM etf_mom), 6) AS rel, coalesce(n, 0) AS news_count
FROM themes LEFT JOIN (SELECT theme, avg(mom_1m) AS mom FROM theme_members JOIN tech USING (ticker) GROUP BY 1) USING (theme)
LEFT JOIN (SELECT theme, count(*) AS n FROM news WHERE date >= DATE '2001-09-01' GROUP BY 1) USING (theme)""")
def chokepoint_heat(t):
    mom = signals.member_mean(t.theme_members, t.quotes, "mom_1m", "mom").select("theme", "mom")
    items = t.news.where(F.col("date") >= "2001-09-01").groupBy("theme").agg(F.count("*").alias("n"))
    heat, rel = signals.chokepoint_heat(F.col("mom"), etf_momentum(t), F.col("n"))
    return t.themes.select("theme").join(mom, "theme", "left").join(items, "theme", "left").select(
        "theme", heat.alias("heat"), rel.alias("rel"), F.coalesce("n", F.lit(0)).alias("news_count"))


@query("PR18", """SELECT source, financial, primary_, CASE WHEN financial >= 10 AND financial > primary_ THEN 'already-legible' ELSE 'early-contrarian' END AS tag,
 round(CASE WHEN financial >= 10 AND financial > primary_ THEN floor(least(0.3e0, financial / 100) * 1000 + 0.5e0) / 1000 ELSE 0e0 END, 6) AS penalty
FROM (SELECT source, count(*) FILTER (lang = 'en') AS financial, count(*) FILTER (lang <> 'en') AS primary_ FROM documents GROUP BY 1)""")
def coverage_legibility(t):
    counts = t.read("documents").groupBy("source").agg(
        F.count_if(F.col("lang") == "en").alias("financial"), F.count_if(F.col("lang") != "en").alias("primary_"))
    tag, penalty = signals.legibility(F.col("financial"), F.col("primary_"))
    return counts.select("source", "financial", "primary_", tag.alias("tag"), penalty.alias("penalty"))


@query("PR18", """SELECT axis, theme, round(rs, 6) AS loading, axis <> 'diversifier' OR rs IS NULL OR rs <= 0.3 AS pass FROM themes LEFT JOIN theme_rs USING (theme)""")
def buildout_gate(t):
    return t.themes.join(theme_strength(t), "theme", "left").select(
        "axis", "theme", F.col("rs").alias("loading"), gate_passes(F.col("axis"), F.col("rs")).alias("pass"))


# ---- valuation -------------------------------------------------------------------------------------

shared(
    facts="""SELECT 'S' || l_suppkey AS ticker, 'EarningsPerShareDiluted' AS concept, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start_d,
       CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE) - 1 AS end_d, sum(l_quantity) / 50 - 4 AS val, 'Q' AS fp, '10-Q' AS form FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY ALL
      UNION ALL SELECT 'S' || l_suppkey, 'EarningsPerShareDiluted', CAST(date_trunc('year', l_shipdate) AS DATE), CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR AS DATE) - 1, sum(l_quantity) / 40 - 20, 'FY', '10-K' FROM lineitem GROUP BY ALL
      UNION ALL SELECT 'S' || l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END, CAST(date_trunc('year', l_shipdate) AS DATE), CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR AS DATE) - 1, sum(l_extendedprice), 'FY', '10-K' FROM lineitem GROUP BY ALL
      UNION ALL SELECT 'S' || l_suppkey, 'NetIncomeLoss', CAST(date_trunc('year', l_shipdate) AS DATE), CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR AS DATE) - 1, sum(l_extendedprice * l_discount), 'FY', '10-K' FROM lineitem GROUP BY ALL""",
    valued="""SELECT ticker, eps_ttm, revenue_yoy, net_margin, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN floor(CASE WHEN abs(a / ((a + b) / 2) - 1) <= 0.15e0 THEN (a + b) / 2 ELSE a END * 10000 + 0.5e0) / 10000 ELSE coalesce(a, b) END AS pe,
      CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a - b) / ((a + b) / 2) <= 0.15e0 END AS ok, a IS NULL OR b IS NULL AS single_source FROM (
      SELECT ticker, eps AS eps_ttm, CASE WHEN eps > 0 THEN floor(price / eps * 10 + 0.5e0) / 10 END AS a, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 > 0 THEN floor(price / 90 + 0.5e0) END AS b,
       floor((r1 / r2 - 1) * 1000 + 0.5e0) / 1000 AS revenue_yoy, floor(ni / r1 * 1000 + 0.5e0) / 1000 AS net_margin FROM (
      SELECT tech.ticker, price, coalesce((SELECT CASE WHEN count(*) = 4 THEN floor(sum(val) * 100 + 0.5e0) / 100 END FROM (SELECT val FROM facts f WHERE f.ticker = tech.ticker AND concept = 'EarningsPerShareDiluted' AND fp = 'Q' ORDER BY end_d DESC LIMIT 4)),
        (SELECT max_by(val, end_d) FROM facts f WHERE f.ticker = tech.ticker AND concept = 'EarningsPerShareDiluted' AND fp = 'FY')) AS eps,
        (SELECT max_by(val, end_d) FROM facts f WHERE f.ticker = tech.ticker AND concept LIKE '%Reven%') AS r1,
        (SELECT max(val) FROM (SELECT val FROM facts f WHERE f.ticker = tech.ticker AND concept LIKE '%Reven%' ORDER BY end_d DESC LIMIT 1 OFFSET 1)) AS r2,
        (SELECT max_by(val, end_d) FROM facts f WHERE f.ticker = tech.ticker AND concept = 'NetIncomeLoss') AS ni FROM tech))""",
)


def company_facts(t):
    k = F.col("l_suppkey")
    ticker = F.concat(F.lit("S"), k).alias("ticker")
    quarter = F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).cast("date")

    def sums(rows, start, *values):
        return rows.groupBy("l_suppkey", start.alias("start_d")).agg(*[F.sum(v).alias(n) for n, v in zip(("units", "sales", "income"), values)])

    def facts(rows, months, fp, form, **values):
        named = F.array(*[F.struct(concept.alias("concept"), F.expr(v).alias("val")) for concept, v in zip(values["concepts"], values["of"])])
        end = F.date_sub(F.add_months("start_d", months), 1)
        return rows.select(ticker, "start_d", end.alias("end_d"), F.lit(fp).alias("fp"), F.lit(form).alias("form"), F.inline(named))

    quarters = t.stored("quarter_sums", lambda: sums(
        t.read("lineitem"), quarter, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")))
    years = sums(quarters, F.date_trunc("year", F.col("start_d").cast("timestamp")).cast("date"), *map(F.col, ("units", "sales", "income")))
    eps, revenue = F.lit("EarningsPerShareDiluted"), F.when(k % 2 == 0, "Revenues").otherwise("SalesRevenueNet")
    return facts(quarters.where(k % 11 != 0), 3, "Q", "10-Q", concepts=[eps], of=["units / 50 - 4"]).unionByName(
        facts(years, 12, "FY", "10-K", concepts=[eps, revenue, F.lit("NetIncomeLoss")], of=["units / 40 - 20", "sales", "income"]))


def valuations(t):
    vendor = t.quotes.select("ticker", F.when(F.expr("substr(ticker, 2)").cast("bigint") % 3 > 0,
                                              F.floor(F.col("price") / 90 + 0.5).cast("double")).alias("vendor_pe"))
    return signals.valuation(company_facts(t), t.quotes, vendor)


@query("AG9", f"SELECT ticker, {r6('eps_ttm', 'pe', 'revenue_yoy', 'net_margin')}, ok, single_source FROM valued")
def trailing_valuation(t):
    return valuations(t)


@query("PR17 AG9", """
WITH p AS (SELECT v.*, theme AS peer_group FROM valued v JOIN securities USING (ticker)),
m AS (SELECT peer_group, list_sort(list(pe) FILTER (pe > 0))[(count(*) FILTER (pe > 0) - 1) // 2 + 1] AS peer_pe FROM p GROUP BY 1)
SELECT ticker, peer_group, round(pe, 6) AS pe, round(peer_pe, 6) AS peer_pe, CASE WHEN pe > 0 THEN CASE WHEN base = 'rich' AND revenue_yoy >= 0.2 THEN 'fair' ELSE base END END AS tag FROM (
SELECT p.*, peer_pe, CASE WHEN peer_pe > 0 THEN CASE WHEN pe / peer_pe < 0.8e0 THEN 'cheap' WHEN pe / peer_pe > 1.25e0 THEN 'rich' ELSE 'fair' END
 ELSE CASE WHEN pe < 15 THEN 'cheap' WHEN pe > 30 THEN 'rich' ELSE 'fair' END END AS base FROM p JOIN m USING (peer_group))""")
def valuation_labels(t):
    peers = t.securities.select("ticker", F.col("theme").alias("peer_group"))
    return signals.label_valuations(valuations(t).join(peers, "ticker"), "peer_group").select(
        "ticker", "peer_group", "pe", "peer_pe", "tag")


# ---- portfolios --------------------------------------------------------------------------------------

shared(
    composite="""SELECT portfolio_id, ticker, account FROM (SELECT h.*, type, count(*) FILTER (type = 'etf') OVER (PARTITION BY portfolio_id) AS etfs
      FROM holdings h LEFT JOIN securities USING (ticker)) WHERE type = 'etf' OR etfs < 3""",
    cash="""SELECT c_custkey AS portfolio_id, CAST(c_acctbal AS DOUBLE) AS cash_usd FROM customer WHERE c_custkey % 3 > 0""",
    usd_positions="""SELECT p.*, price, CASE cur WHEN 'USD' THEN 1e0 WHEN 'EUR' THEN 1.1e0 END * price * shares AS usd FROM (
      SELECT p.*, price, coalesce(currency, CASE WHEN is_foreign THEN 'UNKNOWN' ELSE 'USD' END) AS cur
      FROM positions p LEFT JOIN tech USING (ticker) LEFT JOIN securities USING (ticker)) p""",
)


def fx_rates(t):
    """Rates quoted this run; one currency has none."""
    return t.securities.select("currency").where(F.col("currency") == "EUR").distinct().withColumn("rate", F.lit(1.1))


@query("AG8", f"""SELECT portfolio_id, count(*) AS names, round(avg(pct_vs_ma200), 6) AS trend_vs_200dma, round(avg(mom_12m), 6) AS momentum_12m,
 round(avg(pct_off_high), 6) AS avg_off_high, round(avg(CAST(above_ma200 AS INT)), 6) AS breadth_200, round(avg(CAST(above_ma20 AS INT)), 6) AS breadth_20,
 round(list_sort(list(vol_3m / vol_1y) FILTER (vol_1y > 0))[count(vol_3m / vol_1y) // 2 + 1], 6) AS vol_state,
 CASE WHEN count(*) >= 6 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM composite JOIN tech USING (ticker) GROUP BY 1""")
def regime_components(t):
    return signals.regime_components(universe.composite_members(t.holdings, t.securities).select("portfolio_id", "ticker"), t.quotes)


@query("PR19", """SELECT portfolio_id, CASE WHEN count(usd) > 0 THEN CAST(floor(round(sum(usd) + coalesce(max(cash_usd), 0), 6) + 0.5e0) AS BIGINT) END AS sleeve_usd, count(usd) AS priced,
 count(*) FILTER (price IS NULL) AS missing_price, count(*) FILTER (price IS NOT NULL AND usd IS NULL) AS missing_rate FROM usd_positions LEFT JOIN cash USING (portfolio_id) GROUP BY 1""")
def sleeve_values(t):
    return signals.sleeve_value(signals.position_usd(t.positions, t.quotes, t.securities, fx_rates(t)), t.cash)


@query("AG13", """SELECT portfolio_id, s.sleeve_usd, coalesce(h.trim_hits, 0) AS trim_hits,
 (SELECT abs(avg(pct_off_high)) >= 0.2 FROM tech) AS drawdown_met, coalesce(s.sleeve_usd >= 1720000, false) AS sleeve_met, coalesce(h.trim_hits, 0) > 0 AS trim_met
FROM (SELECT portfolio_id, CASE WHEN count(usd) > 0 THEN CAST(floor(round(sum(usd) + coalesce(max(cash_usd), 0), 6) + 0.5e0) AS BIGINT) END AS sleeve_usd FROM usd_positions LEFT JOIN cash USING (portfolio_id) GROUP BY 1) s
LEFT JOIN (SELECT portfolio_id, count(*) AS trim_hits FROM positions JOIN tech USING (ticker) WHERE price / cost_basis >= 2 AND forward_pe > 50 GROUP BY 1) h USING (portfolio_id)""")
def trigger_conditions(t):
    sleeves = signals.sleeve_value(signals.position_usd(t.positions, t.quotes, t.securities, fx_rates(t)), t.cash)
    average = t.quotes.agg(F.avg("pct_off_high")).scalar()
    return signals.trigger_conditions(sleeves, signals.trim_candidates(t.positions, t.quotes), average, F.lit(False))


@query("ST4 ST5", """
WITH m AS (SELECT ticker AS trigger, d, pct_off_high <= -0.9 AS met FROM tech_series),
f AS (SELECT *, met AND coalesce(lag(met) OVER w, false) AS fired, met AND NOT coalesce(lag(met) OVER w, false) AS pending FROM m WINDOW w AS (PARTITION BY trigger ORDER BY d))
SELECT trigger, d, met, fired, pending, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY trigger ORDER BY d), false) AS newly_fired FROM f""")
def trigger_history(t):
    from tidegauge.operators import technicals

    scans = technicals.series(t.bars).select(F.col("ticker").alias("trigger"), "d", (F.col("pct_off_high") <= -0.9).alias("met"))
    return signals.trigger_edges(scans)


@query("PR20", """
SELECT portfolio_id, ticker, account, location, round(annual_drag, 6) AS annual_drag, round(multiple, 6) AS multiple,
 row_number() OVER (PARTITION BY portfolio_id, ticker, account ORDER BY multiple DESC, location) AS place FROM (
SELECT *, CASE location WHEN 'roth' THEN pow(1 + g, 20) WHEN 'traditional' THEN pow(1 + g, 20) * 0.65e0 ELSE 1 + (pow(1 + g - y * 0.15e0, 20) - 1) * 0.85e0 END AS multiple,
 y * 0.15e0 + CASE WHEN account = 'ira' OR contains(lower(role), 'tactical') THEN 0.2e0 ELSE 0.05e0 END * 0.08e0 * 0.15e0 AS annual_drag FROM (
SELECT *, CASE WHEN div THEN 0.03e0 ELSE 0.008e0 END AS y, CASE WHEN div THEN 0.04e0 ELSE 0.09e0 END AS g, unnest(['roth', 'traditional', 'taxable']) AS location
FROM (SELECT *, axis = 'diversifier' OR contains(lower(role), 'de-correlator') AS div FROM holdings)))""")
def account_location(t):
    sleeves = t.holdings.withColumn("sleeve", universe.sleeve_axis(F.col("axis"), F.col("role")))
    return signals.after_tax_multiples(sleeves).select(
        "portfolio_id", "ticker", "account", "location", "annual_drag", "multiple", F.col("place").cast("bigint").alias("place"))
