"""Queries over the forecast ledger and label history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import history, ledger, regression, signals, sizing
from tidegauge.plans.evaluation import factor_levels
from tidegauge.plans.portfolios import sized_holdings
from tidegauge.plans.prices import r6
from tidegauge.plans.registry import query, shared
from tidegauge.plans.tables import BIND_LEVELS, PRICED_LEVELS, pick
from tidegauge.plans.themes import market_posture, scored, theme_strength

LEDGER_DAY = "2001-06-01"

shared(
    claims="""SELECT o_orderkey AS id, 'S' || k AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END AS claim,
      CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + 21 AS resolve_on
      FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    anchored="""SELECT c.*, b.close AS price_at FROM claims c ASOF LEFT JOIN bars b ON b.ticker = c.subject AND b.d >= c.date""",
    resolved_claims="""SELECT id, subject, claim, date, resolve_on, CASE WHEN done THEN 'resolved' WHEN resolve_on < DATE '2001-06-01' - 180 THEN 'expired' ELSE 'open' END AS status,
      CASE WHEN done THEN gain END AS realized_return, CASE WHEN done THEN CASE claim WHEN 'up' THEN gain > 0 ELSE gain < 0 END END AS correct FROM (
      SELECT a.*, b.close / price_at - 1 AS gain, resolve_on <= DATE '2001-06-01' AND b.close IS NOT NULL AND price_at IS NOT NULL AS done
      FROM anchored a ASOF LEFT JOIN (SELECT * FROM bars WHERE d <= DATE '2001-06-01') b ON b.ticker = a.subject AND b.d >= a.resolve_on)""",
)


def day(t):
    return F.lit(LEDGER_DAY).cast("date")


def anchored(t):
    wanted = t.claims.select("id", F.col("subject").alias("ticker"), "claim", "date", "resolve_on", F.col("date").alias("on"))
    return ledger.price_on_or_after(wanted, t.bars).select(
        "id", F.col("ticker").alias("subject"), "claim", "date", "resolve_on", F.col("price").alias("price_at"))


def resolved(t):
    return ledger.resolve_tilts(anchored(t), t.bars, day(t))


@query("JN4", "SELECT id, subject, date, round(price_at, 6) AS price_at FROM anchored")
def claim_anchors(t):
    return anchored(t).select("id", "subject", "date", "price_at")


@query("ST7 JN4", "SELECT id, subject, claim, date, resolve_on, status, round(realized_return, 6) AS realized_return, correct FROM resolved_claims")
def claim_resolution(t):
    return resolved(t)


@query("ST7", """SELECT 'tsmom_tilt' AS type, '2001-11-05:tsmom_tilt:' || ticker AS id, ticker AS subject, CASE tilt WHEN 'overweight' THEN 'up' ELSE 'down' END AS claim,
 DATE '2001-11-05' AS date, round(price, 6) AS price_at, DATE '2001-11-26' AS resolve_on FROM name_scores JOIN tech USING (ticker)
WHERE tilt IN ('overweight', 'underweight') AND ticker NOT LIKE '%9'""")
def new_tilt_claims(t):
    tilt = signals.momentum_tilt(F.col("mom_12m"), F.col("above_ma200"))
    ok = F.when(F.col("ticker").endswith("9"), False).when(F.col("ticker").endswith("8"), None).otherwise(True)
    return ledger.tilt_claims(t.quotes.select("ticker", "price", tilt.alias("tilt"), ok.alias("ok")), t.scan_date)


shared(kills="""SELECT 'kill:' || theme || ':' || kill_by AS id, theme AS subject, CASE WHEN length(kill_by) = 4 THEN make_date(CAST(kill_by AS INT), 12, 31)
 WHEN length(kill_by) = 7 AND kill_by LIKE '2%' THEN last_day(CAST(kill_by || '-01' AS DATE)) WHEN length(kill_by) = 10 THEN CAST(kill_by AS DATE) END AS resolve_on FROM themes WHERE kill_by <> 'someday'""")


@query("ST7 SF6", "SELECT id, subject, resolve_on, 'thesis_survives' AS claim FROM kills")
def kill_deadlines(t):
    return ledger.kill_claims(t.themes, day(t)).select("id", "subject", "resolve_on", "claim")


@query("SF6", """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 21 AS later, CASE o_orderkey % 4 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN last_day(CAST(o_orderdate AS DATE)) WHEN 2 THEN CAST(o_orderdate AS DATE) END AS due FROM orders""")
def claim_deadlines(t):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM"))
            .when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("someday"))
    return t.read("orders").select("o_orderkey", F.date_add(d, 21).alias("later"), ledger.deadline(text).alias("due"))


@query("AG14", """SELECT CAST(count(*) AS BIGINT) AS matured, count(*) FILTER (subject <> 'N0') AS survived, count(*) FILTER (subject = 'N0') AS killed, count(*) AS needs_review
FROM kills WHERE resolve_on <= DATE '2001-12-31'""")
def kill_outcomes(t):
    later = F.lit("2001-12-31").cast("date")
    kills = ledger.kill_claims(t.themes, day(t))
    return ledger.kill_tally(ledger.resolve_kills(kills, t.themes.where(F.col("theme") != "N0"), later))


shared(
    tc="""SELECT t.theme || ':' || g AS id, t.theme AS basket, 'CX' AS complex, CASE WHEN t.theme = 'N3' THEN 'none' ELSE 'MK' END AS market,
      CASE WHEN priced_in IN ('high', 'crowded') THEN 'underperform' ELSE 'outperform' END AS claim, CAST(g AS DATE) AS date, CAST(g AS DATE) + 42 AS resolve_on
      FROM themes t, range(DATE '1996-01-01', DATE '2001-01-01', INTERVAL 3 MONTH) r(g_ts), (SELECT 1), LATERAL (SELECT CAST(g_ts AS DATE) AS g)""",
    bk="""SELECT theme AS basket, ticker FROM theme_members UNION ALL SELECT 'CX', ticker FROM securities WHERE type = 'etf' UNION ALL SELECT 'MK', 'M'""",
    px="SELECT ticker, d, close FROM bars UNION ALL SELECT ticker, d, close FROM market_bars",
    wins="SELECT DISTINCT basket, date, resolve_on FROM (SELECT basket, date, resolve_on FROM tc UNION ALL SELECT complex, date, resolve_on FROM tc UNION ALL SELECT market, date, resolve_on FROM tc)",
    wret="""SELECT basket, date, resolve_on, avg(p1.close / p0.close - 1) AS r FROM (SELECT * FROM wins JOIN bk USING (basket)) w
      ASOF JOIN px p0 ON p0.ticker = w.ticker AND p0.d >= w.date ASOF JOIN px p1 ON p1.ticker = w.ticker AND p1.d >= w.resolve_on GROUP BY ALL""",
    graded_themes="""SELECT id, basket, claim, date, resolve_on, floor((b - c) * 10000 + 0.5e0) / 10000 AS rel, CASE claim WHEN 'underperform' THEN b - c < 0 ELSE b - c > 0 END AS correct,
      floor((b - m) * 10000 + 0.5e0) / 10000 AS rel_market, CASE claim WHEN 'underperform' THEN b - m < 0 ELSE b - m > 0 END AS correct_vs_market, b - m IS NULL AS market_unresolved FROM (
      SELECT tc.*, x.r AS b, y.r AS c, z.r AS m FROM tc LEFT JOIN wret x ON x.basket = tc.basket AND x.date = tc.date LEFT JOIN wret y ON y.basket = tc.complex AND y.date = tc.date
      LEFT JOIN wret z ON z.basket = tc.market AND z.date = tc.date) WHERE b - c IS NOT NULL""",
)


def theme_claims(t):
    dates = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"), F.expr("INTERVAL 3 MONTH")))
    return t.themes.withColumn("date", dates).select(
        F.concat_ws(":", "theme", F.col("date").cast("string")).alias("id"), F.col("theme").alias("basket"),
        F.lit("CX").alias("complex"), F.when(F.col("theme") == "N3", "none").otherwise("MK").alias("market"),
        F.when(F.col("priced_in").isin("high", "crowded"), "underperform").otherwise("outperform").alias("claim"),
        "date", F.date_add("date", 42).alias("resolve_on"))


def graded_themes(t, until="9999-12-31"):
    etfs = t.securities.where(F.col("type") == "etf").select(F.lit("CX").alias("basket"), "ticker")
    market = t.market_bars.select(F.lit("MK").alias("basket"), "ticker").distinct()
    baskets = t.theme_members.select(F.col("theme").alias("basket"), "ticker").unionByName(etfs).unionByName(market)
    bars = t.bars.unionByName(t.market_bars.select("ticker", "d", "close"))
    return ledger.grade_theme_claims(theme_claims(t), baskets, bars.where(F.col("d") <= F.lit(until).cast("date")))


@query("AG27", f"SELECT id, basket, claim, date, resolve_on, {r6('rel', 'rel_market')}, correct, correct_vs_market, market_unresolved FROM graded_themes")
def theme_claim_grades(t):
    return graded_themes(t)


@query("ST7 AG27", """
WITH lp AS (SELECT * FROM px WHERE d <= DATE '1999-06-30'),
lret AS (SELECT basket, date, resolve_on, avg(p1.close / p0.close - 1) AS r FROM (SELECT * FROM wins JOIN bk USING (basket)) w
 ASOF JOIN lp p0 ON p0.ticker = w.ticker AND p0.d >= w.date ASOF JOIN lp p1 ON p1.ticker = w.ticker AND p1.d >= w.resolve_on GROUP BY ALL),
st AS (SELECT tc.id, claim, tc.resolve_on, x.r - y.r AS rel FROM tc LEFT JOIN lret x ON x.basket = tc.basket AND x.date = tc.date LEFT JOIN lret y ON y.basket = tc.complex AND y.date = tc.date)
SELECT id, claim, resolve_on, CASE WHEN resolve_on <= DATE '1999-06-30' AND rel IS NOT NULL THEN 'resolved' WHEN resolve_on < DATE '1999-06-30' - 180 THEN 'expired' ELSE 'open' END AS status,
 CASE WHEN resolve_on <= DATE '1999-06-30' AND rel IS NOT NULL THEN CASE claim WHEN 'underperform' THEN rel < 0 ELSE rel > 0 END END AS correct FROM st""")
def theme_claim_states(t):
    today = "1999-06-30"
    return ledger.claim_states(theme_claims(t), graded_themes(t, today), F.lit(today).cast("date"))


@query("AG14", """
WITH r AS (SELECT 'tsmom_tilt' AS type, claim, correct, NULL::BOOLEAN AS cm, false AS mu FROM resolved_claims WHERE status = 'resolved'
 UNION ALL SELECT 'scarcity_rel', claim, correct, correct_vs_market, market_unresolved FROM graded_themes)
SELECT coalesce(type, 'all') AS type, coalesce(claim, 'all') AS claim, count(*) AS n, count(*) FILTER (correct) AS hits, round(count(*) FILTER (correct) / count(*), 6) AS hit_rate,
 count(cm) AS n_ext, count(*) FILTER (cm) AS hits_ext, round(count(*) FILTER (cm) / nullif(count(cm), 0), 6) AS hit_rate_ext, count(*) FILTER (mu) AS unresolved_ext
FROM r GROUP BY GROUPING SETS ((type, claim), (type), ())""")
def forecast_scorecard(t):
    tilts = resolved(t).where(F.col("status") == "resolved").select(
        F.lit("tsmom_tilt").alias("type"), "claim", "correct", F.lit(None).cast("boolean").alias("correct_vs_market"),
        F.lit(False).alias("market_unresolved"))
    rel = graded_themes(t).select(F.lit("scarcity_rel").alias("type"), "claim", "correct", "correct_vs_market", "market_unresolved")
    return ledger.scorecard(tilts.unionByName(rel))


@query("AG28 ST7", f"""
WITH w AS (SELECT s.portfolio_id, s.account, s.ticker, s.whole AS su, r.whole AS ru, s.price FROM signal_targets s JOIN research_targets r USING (portfolio_id, account, axis, ticker) WHERE s.price > 0),
n AS (SELECT portfolio_id AS id, ticker, su / sum(su) OVER p AS sw, ru / sum(ru) OVER p AS rw FROM w WINDOW p AS (PARTITION BY portfolio_id) QUALIFY count(*) OVER p >= 2),
k AS (SELECT ticker, min_by(close, d) AS a, max_by(close, d) AS b FROM bars WHERE d >= DATE '2001-06-01' GROUP BY 1)
SELECT id, round(sum(sw * (b / a - 1)) / sum(sw), 6) AS signal_return, round(sum(rw * (b / a - 1)) / sum(rw), 6) AS research_return,
 round(sum(sw * (b / a - 1)) / sum(sw) - sum(rw * (b / a - 1)) / sum(rw), 6) AS rel, sum(sw * (b / a - 1)) / sum(sw) - sum(rw * (b / a - 1)) / sum(rw) > 0 AS correct
FROM n JOIN k USING (ticker) GROUP BY 1""")
def sizing_grades(t):
    both = sizing.targets_by_mode(sized_holdings(t), ["signal", "research"], market_posture(t))
    prices = t.bars.where(F.col("d") >= LEDGER_DAY).groupBy("ticker").agg(
        F.min_by("close", "d").alias("price_at"), F.max_by("close", "d").alias("price_now"))
    return ledger.grade_sizing(ledger.normalized_weights(both, "portfolio_id", "signal_usd", "research_usd"), prices)


@query("ST7 AG10 AG11", """SELECT id, subject, claim, source, resolve_on FROM (
SELECT '2001-11-05:scarcity_rel:' || CASE WHEN f IN ('de-rating', 'inflecting') THEN '' WHEN flow.flag = 'accumulate' THEN 'ff:' ELSE 'opp:' END || theme AS id, theme AS subject,
 CASE WHEN f = 'de-rating' THEN 'underperform' ELSE 'outperform' END AS claim, DATE '2001-12-17' AS resolve_on,
 CASE WHEN f IN ('de-rating', 'inflecting') THEN 'de-rating' WHEN flow.flag = 'accumulate' THEN 'forced-flow' WHEN score >= 60 THEN 'opportunity' END AS source FROM scored
 JOIN flow USING (theme) JOIN (SELECT theme, CASE WHEN priced_in IN ('high', 'crowded') AND rs <= -0.03e0 THEN 'de-rating' WHEN priced_in IN ('low', 'medium') AND rs >= 0.03e0 THEN 'inflecting' ELSE 'none' END AS f
 FROM themes LEFT JOIN theme_rs USING (theme)) USING (theme) WHERE theme IN (SELECT theme FROM theme_members)) WHERE source IS NOT NULL""")
def new_theme_claims(t):
    s = scored(t)
    flow = signals.forced_flow(t.theme_members, t.quotes, s, t.scan_date).select("theme", F.col("flag").alias("flow"))
    priced = t.theme_members.join(t.quotes.select("ticker"), "ticker").select("theme").distinct().withColumn("basket_ok", F.lit(True))
    rows = s.join(theme_strength(t), "theme", "left").join(flow, "theme").join(priced, "theme").withColumn(
        "flag", signals.derating_flag(F.col("priced_in"), F.col("rs")))
    return ledger.theme_claims(rows, t.scan_date).select("id", "subject", "claim", "source", "resolve_on")


@query("SE2", """SELECT id, subject FROM kills WHERE id NOT IN (SELECT id FROM kills WHERE subject IN ('N0', 'N1')) AND NOT (resolve_on <= DATE '2001-06-01')""")
def unseen_claims(t):
    kills = ledger.kill_claims(t.themes, day(t))
    done = ledger.resolve_kills(kills, t.themes, day(t))
    return ledger.new_claims(kills, kills.where(F.col("subject").isin("N0", "N1")), done).select("id", "subject")


@query("AG15", "SELECT ticker, verdict, resolved, verdict AS label, 'factor-adjusted' AS basis FROM fa_verdicts, (SELECT count(*) AS resolved FROM graded_themes)")
def alpha_relabel(t):
    fit = regression.factor_attribution(factor_levels(t), ["ticker"], "asset", ["MKT", "MOM", "THEME"])
    n = graded_themes(t).agg(F.count("*")).scalar()
    return ledger.alpha_label(fit.select("ticker", "verdict"), n)


shared(fa_verdicts="""SELECT ticker, CASE WHEN a0 > 0 AND abs(coalesce(a0 / nullif(sqrt(sse / (n - 4) * (1 / n + m1 * m1 / q1 + u2 * u2 / q2 + u3 * u3 / q3)), 0), 0)) >= 2 THEN 'alpha' ELSE 'factor/beta' END AS verdict FROM (
 SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS a0, CASE WHEN sst - g1 * g1 * q1 - g2 * g2 * q2 - b3 * b3 * q3 > sst * 1e-12 THEN sst - g1 * g1 * q1 - g2 * g2 * q2 - b3 * b3 * q3 ELSE 0e0 END AS sse, m2 - p21 * m1 AS u2, m3 - p31 * m1 - p32 * (m2 - p21 * m1) AS u3 FROM (
 SELECT *, g2 - p32 * b3 AS b2, g1 - p21 * (g2 - p32 * b3) - p31 * b3 AS b1 FROM (
 SELECT ticker, count(*) AS n, sum(y * e3) / sum(e3 * e3) AS b3, sum(y * e2) / sum(e2 * e2) AS g2, sum(y * x1) / sum(x1 * x1) AS g1, sum(e31 * e2) / sum(e2 * e2) AS p32, sum(x1 * x2) / sum(x1 * x1) AS p21,
  sum(x1 * x3) / sum(x1 * x1) AS p31, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, sum(x1 * x1) AS q1, sum(e2 * e2) AS q2, sum(e3 * e3) AS q3, sum(y * y) AS sst FROM (
 SELECT *, e31 - e2 * (sum(e31 * e2) OVER w / sum(e2 * e2) OVER w) AS e3 FROM (
 SELECT *, x2 - x1 * (sum(x1 * x2) OVER w / sum(x1 * x1) OVER w) AS e2, x3 - x1 * (sum(x1 * x3) OVER w / sum(x1 * x1) OVER w) AS e31 FROM (
 SELECT ticker, y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2, x3 - avg(x3) OVER w AS x3, avg(y) OVER w AS my, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(x3) OVER w AS m3
 FROM factor_rets WHERE len >= 81 WINDOW w AS (PARTITION BY ticker)) WINDOW w AS (PARTITION BY ticker)) WINDOW w AS (PARTITION BY ticker)) GROUP BY ticker)))""")


# ---- history -----------------------------------------------------------------------------------------

shared(label_days="""SELECT 'N' || (o_custkey % 25) AS theme, CAST(o_orderdate AS DATE) AS d, ['low', 'medium', 'high', 'crowded'][(min(o_orderkey) // 7) % 4 + 1] AS priced_in,
  ['now', '2027', '2028-29', '2030+', 'physics-floor'][(min(o_orderkey) // 11) % 2 + 1] AS bind_window, min(o_orderkey) % 3 = 0 AS non_consensus FROM orders GROUP BY 1, 2""")


def label_days(t):
    k = F.col("k")
    return t.read("orders").groupBy(
        F.concat(F.lit("N"), F.col("o_custkey") % 25).alias("theme"), F.to_date("o_orderdate").alias("d")).agg(
        F.min("o_orderkey").alias("k")).select(
        "theme", "d", pick(PRICED_LEVELS, F.floor(k / 7) % 4).alias("priced_in"),
        pick(BIND_LEVELS, F.floor(k / 11) % 2).alias("bind_window"), (k % 3 == 0).alias("non_consensus"))


@query("WN28", """SELECT theme, d, priced_in, bind_window, non_consensus FROM (SELECT *, lag(priced_in) OVER w AS a, lag(bind_window) OVER w AS b, lag(non_consensus) OVER w AS c, row_number() OVER w AS k
FROM label_days WINDOW w AS (PARTITION BY theme ORDER BY d)) WHERE k = 1 OR a <> priced_in OR b <> bind_window OR c <> non_consensus""")
def label_history(t):
    return history.label_changes(label_days(t))


@query("WN28", """SELECT theme, min(d) AS since, min_by(priced_in, d) AS priced_in_from, min_by(bind_window, d) AS bind_window_from, max_by(priced_in, d) AS priced_in_to, max_by(bind_window, d) AS bind_window_to
FROM label_days GROUP BY 1 HAVING min_by(priced_in, d) <> max_by(priced_in, d) OR min_by(bind_window, d) <> max_by(bind_window, d)""")
def label_drift(t):
    return history.drift(label_days(t))


@query("ST2", """
WITH s AS (SELECT 'S' || l_suppkey || ':' || l_returnflag AS key, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-06-01' GROUP BY 1),
i AS (SELECT 'S' || l_suppkey || ':' || l_returnflag AS key, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1)
SELECT key, d, key NOT IN (SELECT key FROM s WHERE d >= DATE '2001-06-01' - 90) AS is_new FROM i""")
def first_seen(t):
    key = F.concat_ws(":", F.concat(F.lit("S"), "l_suppkey"), "l_returnflag").alias("key")
    rows = t.read("lineitem").select(key, F.to_date("l_shipdate").alias("d"))
    seen = rows.where(F.col("d") < LEDGER_DAY).groupBy("key").agg(F.max("d").alias("d"))
    items = rows.where(F.col("d") >= LEDGER_DAY).groupBy("key").agg(F.max("d").alias("d"))
    return history.mark_new(items, seen, day(t))


@query("ST6", """
WITH m AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'proposed' END AS status, md5(c_mktsegment) AS h FROM customer WHERE c_custkey % 5 <> 0),
c AS (SELECT c_custkey AS id, md5(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE c_name END) AS h FROM customer)
SELECT c.id, c.h AS evidence_hash, m.id IS NULL OR (status = 'rejected' AND m.h <> c.h) AS fresh FROM c LEFT JOIN m USING (id)""")
def candidate_memory(t):
    c = t.read("customer")
    k = F.col("c_custkey")
    memory = c.where(k % 5 != 0).select(
        k.alias("id"), F.when(k % 3 == 0, "rejected").when(k % 3 == 1, "accepted").otherwise("proposed").alias("status"),
        F.md5(F.col("c_mktsegment").cast("binary")).alias("evidence_hash"))
    candidates = c.select(k.alias("id"), F.md5(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(
        F.col("c_name")).cast("binary")).alias("evidence_hash"))
    return history.split_candidates(candidates, memory)
