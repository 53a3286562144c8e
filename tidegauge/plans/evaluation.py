"""Queries that evaluate series, baskets and timing rules on history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import align, cross_section, diversify, evaluate, metrics, regression, timing
from tidegauge.plans.prices import r6
from tidegauge.plans.registry import query, shared


def metrics_sql(src: str, keys: str, value: str, prefix: str = "", digits: int = 6) -> str:
    """Metrics of one value column, from their definitions."""
    p = prefix
    r = f"round({{}}, {digits})"
    return f"""SELECT {keys}, count(*) AS n,
      {r.format('pow(max_by(v, d) / min_by(v, d), 252.0 / (count(*) - 1)) - 1')} AS {p}cagr,
      {r.format('max(1 - v / peak)')} AS {p}max_drawdown,
      {r.format('(pow(max_by(v, d) / min_by(v, d), 252.0 / (count(*) - 1)) - 1) / nullif(max(1 - v / peak), 0)')} AS {p}calmar,
      {r.format('avg(r) * 252 / nullif(sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(r)) * sqrt(252), 0)')} AS {p}sortino,
      {r.format('avg(r) * 252 / nullif(stddev_samp(r) * sqrt(252), 0)')} AS {p}sharpe,
      {r.format('stddev_samp(r) * sqrt(252)')} AS {p}vol,
      max(1 - v / peak) >= 0.35 AS {p}breaches_35
    FROM (SELECT {keys}, d, {value} AS v, {value} / lag({value}) OVER (PARTITION BY {keys} ORDER BY d) - 1 AS r,
      max({value}) OVER (PARTITION BY {keys} ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM {src}) GROUP BY {keys}"""


shared(
    basket_bars="SELECT 'B' || substr(grp, 2) AS grp, ticker, d, close FROM theme_bars",
    basket_dates="""SELECT grp, d FROM basket_bars GROUP BY grp, d
      HAVING count(*) = (SELECT count(DISTINCT ticker) FROM basket_bars x WHERE x.grp = basket_bars.grp)""",
    basket_first="""SELECT grp, ticker, min_by(close, d) AS base FROM basket_bars SEMI JOIN basket_dates USING (grp, d) GROUP BY 1, 2""",
    basket_values="""SELECT grp, d, 100 * avg(close / base) AS value FROM basket_bars JOIN basket_first USING (grp, ticker)
      SEMI JOIN basket_dates USING (grp, d) GROUP BY grp, d""",
    basket_rets="""SELECT grp, d, avg(r) AS ret FROM (
      SELECT grp, ticker, d, close / lag(close) OVER (PARTITION BY grp, ticker ORDER BY d) - 1 AS r
      FROM basket_bars SEMI JOIN basket_dates USING (grp, d)) WHERE r IS NOT NULL GROUP BY 1, 2""",
    market_rets="SELECT * FROM (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM market_bars) WHERE ret IS NOT NULL",
    complex_rets="SELECT * FROM (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM complex_bars WHERE ticker = 'R0') WHERE ret IS NOT NULL",
    world_dates="SELECT d FROM complex_bars GROUP BY d HAVING count(*) = 5",
)


def basket_bars(t):
    return t.theme_bars.withColumn("grp", F.concat(F.lit("B"), F.expr("substr(grp, 2)")))


def single_returns(t, bars):
    return align.basket_returns(bars.withColumn("grp", F.lit("all"))).select("d", "ret")


@query("AL1 SE4", "SELECT grp, ticker, d, round(close, 6) AS close FROM theme_bars SEMI JOIN common_dates USING (grp, d)")
def aligned_series(t):
    return align.align(t.theme_bars).select("grp", "ticker", "d", "close")


@query("AL2", """
WITH w AS (SELECT *, CAST(substr(ticker, 2) AS INT) + 1 AS w FROM theme_bars SEMI JOIN common_dates USING (grp, d)),
b AS (SELECT grp, ticker, min_by(close, d) AS base FROM w GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT grp, d, round(100 * sum(w * close / base) / sum(w), 6) AS value FROM w JOIN b USING (grp, ticker) GROUP BY grp, d""")
def weighted_index(t):
    weighted = t.theme_bars.withColumn("w", F.expr("substr(ticker, 2)").cast("int") + 1)
    return align.basket_index(weighted, "w")


@query("AL3 SE4", """
WITH axis AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS idx FROM (SELECT DISTINCT d FROM theme_bars)),
p AS (SELECT ticker, idx, close FROM theme_bars JOIN axis USING (d))
SELECT a.ticker, a.idx, round(a.close / b.close - 1, 6) AS trailing FROM p a JOIN p b ON a.ticker = b.ticker AND b.idx = a.idx - 63""")
def union_axis_returns(t):
    return align.offset_returns(t.theme_bars, align.date_axis(t.theme_bars), 63, "trailing").withColumn(
        "idx", F.col("idx").cast("bigint"))


@query("AL4", "SELECT grp, d, round(ret, 6) AS ret FROM basket_rets WHERE grp IN (SELECT grp FROM basket_dates GROUP BY 1 HAVING count(*) >= 31)")
def basket_returns(t):
    return align.basket_returns(basket_bars(t))


@query("AL5", """
WITH parts AS (SELECT grp, 'basket' AS part, d, value FROM basket_values UNION ALL SELECT 'B' || substr(ticker, 2), 'complex', d, close FROM complex_bars),
c AS (SELECT grp, d FROM parts GROUP BY grp, d HAVING count(*) = 2),
b AS (SELECT grp, part, min_by(value, d) AS base FROM parts SEMI JOIN c USING (grp, d) GROUP BY 1, 2)
SELECT grp, d, round(100 * avg(value / base), 6) AS value FROM parts JOIN b USING (grp, part) SEMI JOIN c USING (grp, d)
WHERE grp IN (SELECT grp FROM c GROUP BY 1 HAVING count(*) >= 60) GROUP BY grp, d""")
def blended_sleeve(t):
    """Each basket blended with its region's own series."""
    baskets = align.basket_index(basket_bars(t)).select("grp", F.lit("basket").alias("part"), "d", "value")
    regions = t.complex_bars.select(
        F.concat(F.lit("B"), F.expr("substr(ticker, 2)")).alias("grp"), F.lit("complex").alias("part"), "d", F.col("close").alias("value"))
    return align.blend(baskets.union(regions))


@query("AG1", metrics_sql("bars", "ticker", "close"))
def return_metrics(t):
    return metrics.series_metrics(t.bars, ["ticker"], value="close")


@query("AG2", f"""SELECT m.*, start_d, end_d, round(n / 252.0, 6) AS years FROM ({metrics_sql('basket_values', 'grp', 'value')}) m
JOIN (SELECT grp, min(d) AS start_d, max(d) AS end_d FROM basket_values GROUP BY 1) USING (grp) WHERE n >= 60""")
def basket_stats(t):
    return metrics.basket_stats(align.basket_index(basket_bars(t)))


@query("JN12", """
WITH c AS (SELECT t.ticker, t.d, t.close AS a, m.close AS b FROM theme_bars t JOIN market_bars m USING (d))
SELECT ticker, round(max_by(a, d) / min_by(a, d) - 1, 6) AS asset_return, round(max_by(b, d) / min_by(b, d) - 1, 6) AS benchmark_return,
round(max_by(a, d) / min_by(a, d) - max_by(b, d) / min_by(b, d), 6) AS excess FROM c GROUP BY 1 HAVING count(*) > 1""")
def benchmark_excess(t):
    both = t.theme_bars.join(t.market_bars.select("d", F.col("close").alias("m")), "d")
    return metrics.benchmark_excess(both.withColumn("value", F.col("close")), both.withColumn("value", F.col("m")), ["ticker"])


# ---- timing --------------------------------------------------------------------------------------

shared(
    sig_rows="""SELECT ticker, d, close, row_number() OVER w AS bar, lag(close) OVER w AS prev, ln(close / lag(close) OVER w) AS lr,
      coalesce(lag(close, 252) OVER w, first_value(close) OVER w) AS start,
      CASE WHEN row_number() OVER w >= 200 THEN avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING) END AS sma200,
      CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) END AS sma20
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)""",
    sig="""SELECT *, CASE WHEN bar >= 211 THEN close > sma200 END AS trend,
      CASE WHEN bar >= 211 THEN close / start - 1 < 0 AND vol60 > 0.25 END AS crash_off,
      CASE WHEN bar >= 211 THEN close > sma20 AND sma20 > before END AS thrust FROM (
      SELECT *, close / start - 1 AS ret252, lag(sma20, 10) OVER (PARTITION BY ticker ORDER BY d) AS before,
      CASE WHEN bar > 60 THEN stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING) * sqrt(252) END AS vol60 FROM sig_rows)""",
    sig_last="SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1",
    term="""SELECT ticker, CASE WHEN count(*) FILTER (far > 0) = 3 THEN min(near / far) >= 1 END AS term_inverted,
      max_by(near / far, d) AS term_ratio FROM (
      SELECT t.ticker, t.d, t.close AS near, m.close AS far FROM bars t JOIN market_bars m USING (d)
      QUALIFY row_number() OVER (PARTITION BY t.ticker ORDER BY t.d DESC) <= 3) GROUP BY 1""",
    vels="""SELECT ticker, d, ln(lag(close, 20) OVER (PARTITION BY ticker ORDER BY d) / close) AS v,
      count(*) OVER (PARTITION BY ticker) AS n FROM bars""",
    vel_last="SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM vels",
    credit="""SELECT ticker, max(v) FILTER (k = 1) AS velocity,
      CASE WHEN any_value(n) >= 273 THEN max(v) FILTER (k = 1) >= list_sort(list(v) FILTER (k <= 252))[240] AND max(v) FILTER (k = 1) > 0 END AS credit_stressed
      FROM vel_last GROUP BY 1""",
)


@query("WN10", f"SELECT ticker, d, bar, {r6('sma200', 'sma20', 'ret252', 'vol60')}, trend, crash_off, thrust FROM sig WHERE bar >= 211")
def timing_signals(t):
    return timing.signals(t.bars).where(F.col("bar") >= 211).select(
        "ticker", "d", F.col("bar").cast("bigint").alias("bar"), "sma200", "sma20", "ret252", "vol60",
        "trend", "crash_off", "thrust")


def term_pairs(t):
    return t.bars.withColumnRenamed("close", "near").join(
        t.market_bars.select("d", F.col("close").alias("far")), "d")


@query("WN12", "SELECT ticker, term_inverted, round(term_ratio, 6) AS term_ratio FROM term")
def term_inversion(t):
    return timing.term_inversion(term_pairs(t))


@query("WN13", "SELECT ticker, round(velocity, 6) AS velocity, credit_stressed FROM credit")
def credit_velocity(t):
    return timing.spread_velocity(t.bars)


@query("WN14", """SELECT ticker, term_inverted, credit_stressed,
CASE WHEN term_inverted IS NULL OR credit_stressed IS NULL THEN NULL ELSE term_inverted AND credit_stressed END AS stress,
term_inverted IS NOT NULL AND credit_stressed IS NOT NULL AS available,
CASE WHEN term_inverted IS NULL AND credit_stressed IS NULL THEN 'term,credit' WHEN term_inverted IS NULL THEN 'term' WHEN credit_stressed IS NULL THEN 'credit' ELSE '' END AS missing
FROM term FULL JOIN credit USING (ticker)""")
def composite_stress(t):
    return timing.composite_stress(timing.term_inversion(term_pairs(t)), timing.spread_velocity(t.bars))


@query("WN11", """
SELECT ticker, d, rule, CASE WHEN rule IS NULL THEN 'UNAVAILABLE' WHEN rule IN ('trend', 'thrust') AND NOT stress THEN 'FULL' ELSE 'DEFENSIVE' END AS state,
CASE WHEN rule IS NULL THEN 'unknown' WHEN stress AND rule IN ('trend', 'thrust') THEN 'defensive' WHEN rule = 'trend' THEN 'risk-on' WHEN rule = 'thrust' THEN 'neutral' ELSE 'defensive' END AS posture,
coalesce(stress AND rule IN ('trend', 'thrust'), false) AS overlay_applied, coalesce(rule = 'thrust' AND NOT stress, false) AS fast_reentry, trend, crash_off, thrust
FROM (SELECT *, coalesce(term_inverted AND credit_stressed, false) AS stress,
  CASE WHEN trend IS NULL THEN NULL WHEN crash_off THEN 'crash' WHEN trend THEN 'trend' WHEN thrust THEN 'thrust' ELSE 'cash' END AS rule
  FROM sig_last LEFT JOIN term USING (ticker) LEFT JOIN credit USING (ticker))""")
def ladder_state(t):
    stress = timing.composite_stress(timing.term_inversion(term_pairs(t)), timing.spread_velocity(t.bars))
    return timing.ladder_state(timing.latest(timing.signals(t.bars)).join(stress.select("ticker", "stress"), "ticker", "left"))


# ---- rules on history ------------------------------------------------------------------------------


def path_sql(decided: str, first: int, base: bool) -> str:
    """Equity of a decided rule as a running product."""
    lo = first - 1 if base else first
    return f"""SELECT ticker, d, bar, pos, sw, 100 * product(ret) OVER w AS hold,
      100 * product((CASE WHEN pos = 1 THEN ret ELSE 1 END) * (CASE WHEN sw THEN 0.999 ELSE 1 END)) OVER w AS timed
      FROM (SELECT ticker, d, bar, CASE WHEN bar >= {first} THEN pos END AS pos, CASE WHEN bar >= {first} THEN close / prev ELSE 1 END AS ret,
        coalesce(bar > {first} AND pos <> lag(pos) OVER (PARTITION BY ticker ORDER BY d), false) AS sw FROM {decided})
      WHERE bar >= {lo} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)"""


shared(
    ma_decided="""SELECT *, count(*) OVER (PARTITION BY ticker) AS len,
      CASE WHEN lag(close) OVER w > lag(sma200) OVER w THEN 1 ELSE 0 END AS pos FROM sig_rows WINDOW w AS (PARTITION BY ticker ORDER BY d)""",
    ma_base_path=path_sql("ma_decided", 201, True),
    ma_path=path_sql("ma_decided", 201, False),
    ladder_decided="""SELECT *, lag(CASE WHEN crash_off THEN 0 WHEN trend OR thrust THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY d) AS pos,
      count(*) OVER (PARTITION BY ticker) AS len FROM sig""",
    ladder_rows=path_sql("(SELECT * FROM ladder_decided WHERE len >= 271)", 212, False),
    ladder_mixed="SELECT *, 0.4 * timed + 0.6 * hold AS mixed FROM ladder_rows",
)


@query("WN15", f"""
SELECT t.* EXCLUDE (n), h.* EXCLUDE (ticker, n), t.n, whipsaws, round(time_in_market, 6) AS time_in_market, periods,
round(hold_dd - timed_dd, 6) AS dd_reduction, whipsaws * 10e0 AS turnover_cost_bps
FROM ({metrics_sql('ma_base_path', 'ticker', 'timed', 'timed_')}) t JOIN ({metrics_sql('ma_base_path', 'ticker', 'hold', 'hold_')}) h USING (ticker)
JOIN (SELECT ticker, count(*) FILTER (sw) AS whipsaws, avg(pos) AS time_in_market, count(pos) AS periods FROM ma_base_path GROUP BY 1) u USING (ticker)
JOIN (SELECT ticker, max(1 - hold / ph) AS hold_dd, max(1 - timed / pt) AS timed_dd FROM (SELECT ticker, hold, timed,
  max(hold) OVER w AS ph, max(timed) OVER w AS pt FROM ma_base_path WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)) GROUP BY 1) USING (ticker)""")
def moving_average_rule(t):
    return evaluate.rule_summary(evaluate.moving_average_path(t.bars, with_base=True))


def episodes_sql(src: str, keys: str, base: str, others: list[str]) -> str:
    """Episodes found by walking out from each running peak to the next close at or above it."""
    dd = ", ".join(f"""round((SELECT max(1 - x.{o} / (SELECT max(y.{o}) FROM pts y WHERE y.{keys} = x.{keys} AND y.i BETWEEN e.i0 AND x.i))
      FROM pts x WHERE x.{keys} = e.{keys} AND x.i BETWEEN e.i0 AND e.i1), 6) AS {o}_dd""" for o in others)
    helped = ", ".join(f"{o}_dd < depth - 0.005 AS {o}_helped" for o in others)
    cols = "".join(f", {o}" for o in others)
    return f"""
pts AS (SELECT {keys}, d, {base} AS b{cols}, row_number() OVER (PARTITION BY {keys} ORDER BY d) AS i FROM {src}),
tops AS (SELECT * FROM (SELECT *, max(b) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM pts)
  WHERE pm IS NULL OR b >= pm),
spans AS (SELECT {keys}, i AS i0, d AS from_d, b AS peak, lead(i, 1, 1000000) OVER (PARTITION BY {keys} ORDER BY i) AS nxt FROM tops),
eps AS (SELECT s.{keys}, s.i0, s.from_d, min_by(p.i, p.b) AS i1, min_by(p.d, p.b) AS to_d, 1 - min(p.b) / any_value(s.peak) AS depth
  FROM spans s JOIN pts p ON p.{keys} = s.{keys} AND p.i >= s.i0 AND p.i < s.nxt GROUP BY 1, 2, 3 HAVING 1 - min(p.b) / any_value(s.peak) >= 0.2),
full_eps AS (SELECT {keys}, from_d, to_d, round(depth, 6) AS depth, {dd} FROM eps e)
SELECT *, {helped} FROM full_eps"""


@query("WN16", "WITH " + episodes_sql("ma_path", "ticker", "hold", ["timed"]))
def drawdown_episodes(t):
    path = evaluate.moving_average_path(t.bars, min_bars=260)
    return evaluate.drawdown_episodes(path, ["ticker"], "hold", ["timed"])


def proof_sql(src: str, values: list[str]) -> str:
    sides = " JOIN ".join(f"({metrics_sql(src, 'ticker', v, v + '_', 4)}) m{i}" + (" USING (ticker)" if i else "")
                          for i, v in enumerate(values))
    drop = ", ".join(f"m{i}.* EXCLUDE (ticker, n)" for i in range(len(values)))
    return f"""SELECT ticker, m0.n, {drop}, start_d, end_d, switches, round((end_d - start_d) / 365.25, 6) AS years,
round(hold_max_drawdown - timed_max_drawdown, 4) AS max_dd_reduction, round(coalesce(hold_cagr, 0) - coalesce(timed_cagr, 0), 4) AS cagr_cost,
timed_max_drawdown < hold_max_drawdown AS reduces_tail, coalesce(timed_calmar, '-inf'::DOUBLE) > coalesce(hold_calmar, '-inf'::DOUBLE) AS improves_calmar
FROM {sides} JOIN (SELECT ticker, min(d) AS start_d, max(d) AS end_d, count(*) FILTER (sw) AS switches FROM {src} GROUP BY 1) USING (ticker) WHERE m0.n >= 60"""


@query("WN17", proof_sql("ma_path", ["hold", "timed"]))
def rule_proof(t):
    return evaluate.rule_proof(evaluate.moving_average_path(t.bars, min_bars=260))


@query("WN19", proof_sql("ladder_mixed", ["hold", "timed", "mixed"]))
def ladder_proof(t):
    return evaluate.rule_proof(evaluate.ladder_path(t.bars), blend=0.4)


@query("WN19 WN16", "WITH " + episodes_sql("ladder_mixed", "ticker", "hold", ["timed", "mixed"]))
def ladder_episodes(t):
    path = evaluate.ladder_path(t.bars).withColumn("mixed", 0.4 * F.col("timed") + 0.6 * F.col("hold"))
    return evaluate.drawdown_episodes(path, ["ticker"], "hold", ["timed", "mixed"])


shared(
    world_named="""SELECT ticker, d, close, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY d) >= 20
      THEN avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) END AS ma FROM complex_bars SEMI JOIN world_dates USING (d)""",
    world_base="SELECT ticker, min_by(close, d) AS base FROM world_named GROUP BY 1",
    world_index="""SELECT d, 100 * avg(close / base) AS value, avg(CASE WHEN close > ma THEN 1.0 WHEN close <= ma THEN 0.0 END) AS breadth
      FROM world_named JOIN world_base USING (ticker) GROUP BY d""",
    world_pos="""SELECT *, coalesce(trend, false) AS tr, coalesce(b1 >= 0.6 AND b2 >= 0.6, false) AS wide FROM (
      SELECT d, value, bar, value / pv AS ret, pv > lag(ma) OVER (ORDER BY d) AS trend, b1, b2 FROM (
      SELECT d, value, row_number() OVER (ORDER BY d) AS bar, lag(value) OVER (ORDER BY d) AS pv, lag(breadth) OVER (ORDER BY d) AS b1,
      lag(breadth, 2) OVER (ORDER BY d) AS b2, CASE WHEN row_number() OVER (ORDER BY d) >= 200 THEN avg(value) OVER (ORDER BY d ROWS 199 PRECEDING) END AS ma
      FROM world_index)) WHERE bar > 200 AND (SELECT count(*) FROM world_index) >= 260""",
    world_steps="SELECT *, CASE WHEN tr THEN 1e0 ELSE 0e0 END AS pp, CASE WHEN tr THEN 1e0 WHEN wide THEN 0.5e0 ELSE 0e0 END AS fp FROM world_pos",
    world_path="""SELECT 'W' AS grp, d, bar, pp AS plain_pos, fp AS fast_pos, 100 * product(ret) OVER w AS hold,
      100 * product((1 + pp * (ret - 1)) * (1 - 0.001 * coalesce(abs(pp - lp), 0))) OVER w AS plain,
      100 * product((1 + fp * (ret - 1)) * (1 - 0.001 * coalesce(abs(fp - lf), 0))) OVER w AS fast
      FROM (SELECT *, lag(pp) OVER (ORDER BY d) AS lp, lag(fp) OVER (ORDER BY d) AS lf FROM world_steps) WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING)""",
)


def world_path(t):
    return evaluate.breadth_path(t.complex_bars.withColumn("grp", F.lit("W")))


@query("WN18", f"SELECT grp, d, bar, plain_pos, fast_pos, {r6('hold', 'plain', 'fast')} FROM world_path")
def breadth_reentry_path(t):
    return world_path(t).withColumn("bar", F.col("bar").cast("bigint"))


@query("WN18", f"""SELECT grp, h.n, h.* EXCLUDE (grp, n), p.* EXCLUDE (grp, n), f.* EXCLUDE (grp, n), start_d, end_d, round((end_d - start_d) / 365.25, 6) AS years,
round(tp, 6) AS time_in_market_plain, round(tf, 6) AS time_in_market_fast, round(fast_cagr - plain_cagr, 4) AS cagr_gain,
round(fast_max_drawdown - plain_max_drawdown, 4) AS maxdd_cost, fast_cagr > plain_cagr AS improves_cagr, fast_calmar > plain_calmar AS worth_it
FROM ({metrics_sql('world_path', 'grp', 'hold', 'hold_', 4)}) h JOIN ({metrics_sql('world_path', 'grp', 'plain', 'plain_', 4)}) p USING (grp)
JOIN ({metrics_sql('world_path', 'grp', 'fast', 'fast_', 4)}) f USING (grp)
JOIN (SELECT grp, min(d) AS start_d, max(d) AS end_d, avg(CASE WHEN plain_pos > 0 THEN 1.0 ELSE 0.0 END) AS tp,
  avg(CASE WHEN fast_pos > 0 THEN 1.0 ELSE 0.0 END) AS tf FROM world_path GROUP BY 1) USING (grp)""")
def breadth_reentry_proof(t):
    return evaluate.breadth_proof(world_path(t))


@query("WN20", """
WITH axis AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS idx FROM (SELECT d FROM theme_bars UNION SELECT d FROM complex_bars)),
prices AS (SELECT ticker, grp, idx, close FROM (SELECT ticker, grp, d, close FROM theme_bars UNION ALL SELECT ticker, 'C', d, close FROM complex_bars) JOIN axis USING (d)),
steps AS (SELECT DISTINCT idx FROM axis WHERE idx >= 63 AND (idx - 63) % 21 = 0),
tr AS (SELECT a.grp, s.idx, avg(a.close / b.close - 1) AS r FROM steps s JOIN prices a ON a.idx = s.idx JOIN prices b ON b.ticker = a.ticker AND b.idx = s.idx - 63 GROUP BY 1, 2),
fw AS (SELECT a.grp, s.idx, avg(a.close / b.close - 1) AS r FROM steps s JOIN prices a ON a.idx = s.idx + 42 JOIN prices b ON b.ticker = a.ticker AND b.idx = s.idx GROUP BY 1, 2),
pairs AS (SELECT g.grp, g.idx, g.r - c.r AS s, gf.r - cf.r AS f FROM tr g JOIN tr c ON c.grp = 'C' AND c.idx = g.idx
  JOIN fw gf ON gf.grp = g.grp AND gf.idx = g.idx JOIN fw cf ON cf.grp = 'C' AND cf.idx = g.idx WHERE g.grp <> 'C'),
rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf FROM pairs),
o AS (SELECT count(*) AS n, corr(rs, rf) AS ic, count(*) FILTER (s <> 0) AS scored, count(*) FILTER (s <> 0 AND sign(s) = sign(f)) AS hits FROM rk)
SELECT n, round(ic, 6) AS ic, scored, hits, round(hits / scored, 6) AS hit_rate,
 round(hits / scored - 1.96 * sqrt(hits / scored * (1 - hits / scored) / scored), 6) AS hit_low,
 round(hits / scored + 1.96 * sqrt(hits / scored * (1 - hits / scored) / scored), 6) AS hit_high FROM o WHERE n >= 12""")
def signal_rank_ic(t):
    series = t.theme_bars.select("ticker", "d", "close").unionByName(t.complex_bars.select("ticker", "d", "close"))
    members = t.theme_bars.select("grp", "ticker").distinct()
    return cross_section.rank_ic(cross_section.relative_pairs(
        series, members, t.complex_bars.select("ticker").distinct()))


# ---- regression ------------------------------------------------------------------------------------

shared(
    factor_levels="""SELECT t.ticker, t.d, t.close AS asset, m.close AS mkt, x.close AS mom, c.close AS theme FROM theme_bars t
      JOIN market_bars m USING (d) JOIN complex_bars c ON c.d = t.d AND c.ticker = t.grp
      JOIN complex_bars x ON x.d = t.d AND x.ticker = 'R' || ((CAST(substr(t.grp, 2) AS INT) + 1) % 5)""",
    factor_rets="""SELECT * FROM (SELECT ticker, d, asset / lag(asset) OVER w - 1 AS y, mkt / lag(mkt) OVER w - 1 AS x1,
      mom / lag(mom) OVER w - 1 AS x2, theme / lag(theme) OVER w - 1 AS x3, count(*) OVER (PARTITION BY ticker) AS len
      FROM factor_levels WINDOW w AS (PARTITION BY ticker ORDER BY d)) WHERE y IS NOT NULL""",
)


def factor_levels(t):
    own = F.expr("substr(grp, 2)").cast("int")
    return (
        t.theme_bars.withColumnRenamed("close", "asset").withColumn("_x", F.concat(F.lit("R"), (own + 1) % 5))
        .join(t.market_bars.select("d", F.col("close").alias("MKT")), "d")
        .join(t.complex_bars.select(F.col("ticker").alias("grp"), "d", F.col("close").alias("THEME")), ["grp", "d"])
        .join(t.complex_bars.select(F.col("ticker").alias("_x"), "d", F.col("close").alias("MOM")), ["_x", "d"])
        .select("ticker", "d", "asset", "MKT", "MOM", "THEME"))


@query("AG3", f"""
SELECT ticker, count(*) AS n, {r6('coef_0', 'coef_1', 'se_1', 't_1', 'r2')} FROM (
 SELECT ticker, y, regr_intercept(y, x1) OVER w AS coef_0, regr_slope(y, x1) OVER w AS coef_1, regr_r2(y, x1) OVER w AS r2,
  sqrt(regr_syy(y, x1) OVER w * (1 - regr_r2(y, x1) OVER w) / (count(*) OVER w - 2) / regr_sxx(y, x1) OVER w) AS se_1,
  regr_slope(y, x1) OVER w / sqrt(regr_syy(y, x1) OVER w * (1 - regr_r2(y, x1) OVER w) / (count(*) OVER w - 2) / regr_sxx(y, x1) OVER w) AS t_1
 FROM factor_rets WINDOW w AS (PARTITION BY ticker)) GROUP BY ALL HAVING count(*) > 3""")
def market_fit(t):
    rets = regression.level_returns(factor_levels(t), ["ticker"], ["asset", "MKT"])
    return regression.ols(rets, ["ticker"], "asset", ["MKT"]).select(
        "ticker", "n", "coef_0", "coef_1", "se_1", "t_1", "r2")


# Three regressors without a matrix: orthogonalise one after the other (Frisch-Waugh).
@query("AG3 AG4", """
WITH c AS (SELECT ticker, y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2, x3 - avg(x3) OVER w AS x3,
   avg(y) OVER w AS my, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(x3) OVER w AS m3 FROM factor_rets WHERE len >= 81 WINDOW w AS (PARTITION BY ticker)),
a AS (SELECT *, x2 - x1 * (sum(x1 * x2) OVER w / sum(x1 * x1) OVER w) AS e2, x3 - x1 * (sum(x1 * x3) OVER w / sum(x1 * x1) OVER w) AS e31 FROM c WINDOW w AS (PARTITION BY ticker)),
b AS (SELECT *, e31 - e2 * (sum(e31 * e2) OVER w / sum(e2 * e2) OVER w) AS e3 FROM a WINDOW w AS (PARTITION BY ticker)),
k AS (SELECT ticker, count(*) AS n, sum(y * e3) / sum(e3 * e3) AS b3, sum(y * e2) / sum(e2 * e2) AS g2, sum(y * x1) / sum(x1 * x1) AS g1,
   sum(e31 * e2) / sum(e2 * e2) AS p32, sum(x1 * x2) / sum(x1 * x1) AS p21, sum(x1 * x3) / sum(x1 * x1) AS p31,
   any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3,
   sum(x1 * x1) AS q1, sum(e2 * e2) AS q2, sum(e3 * e3) AS q3, sum(y * y) AS sst FROM b GROUP BY ticker),
f AS (SELECT *, g2 - p32 * b3 AS b2, g1 - p21 * (g2 - p32 * b3) - p31 * b3 AS b1 FROM k),
s AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS a0, CASE WHEN sst - g1 * g1 * q1 - g2 * g2 * q2 - b3 * b3 * q3 > sst * 1e-12 THEN sst - g1 * g1 * q1 - g2 * g2 * q2 - b3 * b3 * q3 ELSE 0e0 END AS sse,
   m2 - p21 * m1 AS u2, m3 - p31 * m1 - p32 * (m2 - p21 * m1) AS u3 FROM f)
SELECT ticker, n, round(a0 * 252, 6) AS alpha_annual, round(coalesce(a0 / nullif(sqrt(sse / (n - 4) * (1 / n + m1 * m1 / q1 + u2 * u2 / q2 + u3 * u3 / q3)), 0), 0), 6) AS alpha_t,
 round(b1, 6) AS beta_mkt, round(b2, 6) AS beta_mom, round(b3, 6) AS beta_theme, round(1 - sse / sst, 6) AS r2,
 CASE WHEN a0 > 0 AND abs(coalesce(a0 / nullif(sqrt(sse / (n - 4) * (1 / n + m1 * m1 / q1 + u2 * u2 / q2 + u3 * u3 / q3)), 0), 0)) >= 2 THEN 'alpha' ELSE 'factor/beta' END AS verdict FROM s""")
def factor_attribution(t):
    return regression.factor_attribution(factor_levels(t), ["ticker"], "asset", ["MKT", "MOM", "THEME"])


shared(
    stage_one="""SELECT d, m, c - regr_intercept(c, m) OVER () - regr_slope(c, m) OVER () * m AS f
      FROM (SELECT d, m.ret AS m, c.ret AS c FROM market_rets m JOIN complex_rets c USING (d))""",
    loading="""SELECT grp, n, cov_m * inv / vm AS marketless, bm AS market_beta, bf AS residual_beta, bf / sqrt(sse / (n - 3) / qf) AS residual_t, 1 - sse / sst AS r2 FROM (
      SELECT *, 1.0 AS inv, (cov_m - bf * cov_mf) / vm AS bm, sst - cov_m * cov_m / vm - bf * bf * qf AS sse FROM (
      SELECT *, (cov_f - cov_m * cov_mf / vm) / (vf - cov_mf * cov_mf / vm) AS bf, vf - cov_mf * cov_mf / vm AS qf FROM (
      SELECT grp, count(*) AS n, regr_sxx(ret, m) AS vm, regr_sxx(ret, f) AS vf, regr_sxy(f, m) AS cov_mf, regr_sxy(ret, m) AS cov_m,
      regr_sxy(ret, f) AS cov_f, regr_syy(ret, m) AS sst FROM basket_rets JOIN stage_one USING (d) GROUP BY grp HAVING count(*) >= 60)))""",
)


@query("AG5", f"SELECT grp, n, {r6('market_beta', 'residual_beta', 'residual_t', 'r2')}, residual_beta <= 0.3 AS qualifies FROM loading")
def residual_loading(t):
    return regression.residual_loading(
        align.basket_returns(basket_bars(t)), single_returns(t, t.market_bars),
        single_returns(t, t.complex_bars.where(F.col("ticker") == "R0")))


@query("AG6", f"""SELECT grp, n, {r6('corr', 'beta', 'r2')}, abs(corr) < 0.5 AND abs(beta) < 0.7 AS qualifies FROM (
SELECT grp, count(*) AS n, corr(b.ret, c.ret) AS corr, regr_slope(b.ret, c.ret) AS beta, regr_r2(b.ret, c.ret) AS r2
FROM basket_rets b JOIN complex_rets c USING (d) GROUP BY grp HAVING count(*) >= 60)""")
def axis_correlation(t):
    return regression.axis_correlation(
        align.basket_returns(basket_bars(t)), single_returns(t, t.complex_bars.where(F.col("ticker") == "R0")))


shared(
    plan_values="""SELECT d, 100 * avg(close / base) AS value FROM (SELECT ticker, d, close, first_value(close) OVER (PARTITION BY ticker ORDER BY d) AS base
      FROM complex_bars WHERE ticker IN ('R3', 'R4') AND d IN (SELECT d FROM complex_bars WHERE ticker IN ('R3', 'R4') GROUP BY d HAVING count(*) = 2)) GROUP BY d""",
    plan_mix="""SELECT grp, d, 100 * (b.value / first_value(b.value) OVER w + p.value / first_value(p.value) OVER w) / 2 AS value,
      count(*) OVER (PARTITION BY grp) AS len FROM basket_values b JOIN plan_values p USING (d) WINDOW w AS (PARTITION BY grp ORDER BY d)""",
)


@query("AG7", f"""
WITH st AS ({metrics_sql('basket_values', 'grp', 'value')}), bl AS (SELECT grp, max_drawdown AS blended FROM ({metrics_sql('(SELECT * FROM plan_mix WHERE len >= 60)', 'grp', 'value', '', 12)})),
pl AS (SELECT max_drawdown AS plan FROM ({metrics_sql("(SELECT 1 AS one, * FROM plan_values)", 'one', 'value', '', 12)}))
SELECT grp, n, years, start_d, end_d, cagr, max_drawdown, calmar, sortino, sharpe, vol, breaches_35, {r6('market_beta', 'residual_beta', 'residual_t', 'r2')},
 round(blended, 6) AS blended_max_dd, round(plan - blended, 6) AS dd_reduction, reason, starts_with(reason, 'qualifies') AS qualifies FROM (
SELECT g.grp, st.* EXCLUDE (grp), round(st.n / 252.0, 6) AS years, CASE WHEN st.n IS NOT NULL THEN x.start_d END AS start_d, CASE WHEN st.n IS NOT NULL THEN x.end_d END AS end_d, l.* EXCLUDE (grp, n), bl.blended, pl.plan,
 CASE WHEN residual_beta IS NULL OR st.n IS NULL THEN 'insufficient price history' WHEN residual_beta > 0.3 THEN 'amplifies the build-out' WHEN market_beta > 0.95 THEN 'moves too much with the market'
  WHEN max_drawdown > 0.5 THEN 'drawdown over the cap' WHEN plan - blended <= 0 THEN 'qualifies, redundant with the plan' ELSE 'qualifies' END AS reason
FROM (SELECT DISTINCT grp FROM basket_bars) g LEFT JOIN (SELECT * FROM st WHERE n >= 60) st USING (grp) LEFT JOIN (SELECT grp, min(d) AS start_d, max(d) AS end_d FROM basket_values GROUP BY 1) x USING (grp) LEFT JOIN loading l USING (grp) LEFT JOIN bl USING (grp) CROSS JOIN pl)""")
def diversifier_screen(t):
    plan = align.basket_index(
        t.complex_bars.where(F.col("ticker").isin("R3", "R4")).withColumn("grp", F.lit("plan"))).select("d", "value")
    return diversify.screen(
        basket_bars(t), single_returns(t, t.market_bars),
        single_returns(t, t.complex_bars.where(F.col("ticker") == "R0")), plan)
