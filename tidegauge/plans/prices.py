"""Queries over daily price series: technicals, store rules, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.scalar import positive
from tidegauge.operators import align, quality, reconcile, technicals, universe
from tidegauge.plans.registry import query, shared
from tidegauge.session import cut
from tidegauge.sources import store

shared(
    bars="""SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS close FROM lineitem GROUP BY 1, 2""",
    theme_bars="""SELECT 'N' || n_nationkey AS ticker, 'R' || n_regionkey AS grp, CAST(l_shipdate AS DATE) AS d,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS close
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    complex_bars="""SELECT 'R' || n_regionkey AS ticker, CAST(l_shipdate AS DATE) AS d,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS close
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    market_bars="""SELECT 'M' AS ticker, CAST(l_shipdate AS DATE) AS d,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS close FROM lineitem GROUP BY 1, 2""",
    raw_bars="""SELECT CASE l_returnflag WHEN 'A' THEN 'yahoo' WHEN 'N' THEN 'stooq' ELSE 'tiingo' END AS provider,
      'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS close FROM lineitem GROUP BY 1, 2, 3""",
    price_rows="""SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
      CASE l_returnflag WHEN 'A' THEN 'yahoo' WHEN 'N' THEN 'consensus' ELSE 'scraped' END AS source,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS close FROM lineitem GROUP BY 1, 2, 3""",
    bar_returns="""SELECT *, row_number() OVER w AS bar, ln(close / lag(close) OVER w) AS lr
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)""",
    tech_series="""SELECT ticker, d, bar, close AS price,
      max(close) OVER (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING) AS high52,
      close / max(close) OVER (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING) - 1 AS pct_off_high,
      close / first_value(close) OVER (PARTITION BY ticker, year(d) ORDER BY d) - 1 AS ytd,
      CASE WHEN bar >= 20 THEN avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) END AS ma20,
      CASE WHEN bar >= 50 THEN avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING) END AS ma50,
      CASE WHEN bar >= 200 THEN avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING) END AS ma200,
      close / lag(close, 252) OVER (PARTITION BY ticker ORDER BY d) - 1 AS mom_12m,
      close / lag(close, 22) OVER (PARTITION BY ticker ORDER BY d) - 1 AS mom_1m,
      CASE WHEN bar >= 64 THEN stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS 62 PRECEDING) * sqrt(252) END AS vol_3m,
      CASE WHEN bar >= 253 THEN stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING) * sqrt(252) END AS vol_1y
      FROM bar_returns""",
    tech="""SELECT * EXCLUDE (d), d AS as_of, price / ma50 - 1 AS pct_vs_ma50, price / ma200 - 1 AS pct_vs_ma200,
      price >= ma200 AS above_ma200, price >= ma20 AS above_ma20
      FROM tech_series QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1""",
)


def r6(*names: str) -> str:
    """Select list that rounds columns to the presentation precision."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


TECH_FLOATS = ("price", "high52", "pct_off_high", "ytd", "ma20", "ma50", "ma200", "mom_12m", "mom_1m",
               "vol_3m", "vol_1y")

shared(supp_names="SELECT 'S' || s_suppkey AS ticker, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")


@query("WN1 WN2 WN4 WN5 WN7", f"""
SELECT ticker, s_name, n_name, as_of, {r6('price', 'mom_12m', 'vol_1y', 'pct_off_high')}
FROM tech JOIN supp_names USING (ticker) WHERE mom_12m IS NOT NULL
ORDER BY tech.mom_12m DESC, ticker LIMIT 20""")
def momentum_leaders(t):
    names = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), "s_name", "n_name")
    return (
        t.quotes.where(F.col("mom_12m").isNotNull())
        .orderBy(F.desc("mom_12m"), "ticker").limit(20)
        .join(names, "ticker")
        .select("ticker", "s_name", "n_name", "as_of", "price", "mom_12m", "vol_1y", "pct_off_high"))


RSI_RECURRENCE = """
WITH RECURSIVE moves AS MATERIALIZED (
  SELECT ticker, d, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS x
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
seed AS (SELECT ticker, avg(greatest(x, 0)) AS g, avg(greatest(-x, 0)) AS l FROM moves WHERE i BETWEEN 1 AND {p} GROUP BY ticker
         HAVING count(*) = {p}),
walk AS (
  SELECT ticker, {p} AS i, g, l FROM seed
  UNION ALL
  SELECT w.ticker, w.i + 1, (w.g * ({p} - 1) + greatest(m.x, 0)) / {p}, (w.l * ({p} - 1) + greatest(-m.x, 0)) / {p}
  FROM walk w JOIN moves m ON m.ticker = w.ticker AND m.i = w.i + 1)
SELECT ticker, {what}CASE WHEN l = 0 THEN 100 ELSE round(100 - 100 / (1 + g / l), 6) END AS {name}
FROM walk {join}"""
RSI_LAST = RSI_RECURRENCE.format(p="{p}", what="", name="rsi_{p}", join="QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY i DESC) = 1")


@query("WN1 WN2 WN4 WN5 WN6 WN7", f"""
SELECT ticker, as_of, bar, {r6(*TECH_FLOATS, 'pct_vs_ma50', 'pct_vs_ma200')}, above_ma200, above_ma20, rsi_14, rsi_10 FROM tech
LEFT JOIN ({RSI_LAST.format(p=14)}) USING (ticker) LEFT JOIN ({RSI_LAST.format(p=10)}) USING (ticker)""")
def technicals_snapshot(t):
    return t.quotes.withColumn("bar", F.col("bar").cast("bigint"))


@query("WN1 WN2 WN4 WN5 WN6", f"SELECT ticker, d, bar, {r6(*TECH_FLOATS)} FROM tech_series")
def technicals_series(t):
    return technicals.series(t.bars).select("ticker", "d", F.col("bar").cast("bigint").alias("bar"), *TECH_FLOATS)


@query("WN3", RSI_LAST.format(p=14))
def wilder_rsi(t):
    return technicals.rsi(t.bars, 14)


@query("WN3", f"""SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 5 > 1 THEN rsi_14 END AS rsi_14,
CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 5 > 1 THEN rsi_10 END AS rsi_10 FROM ({RSI_LAST.format(p=14)}) JOIN ({RSI_LAST.format(p=10)}) USING (ticker)""")
def guarded_rsi(t):
    """A missing or non-finite first close leaves no index for the whole ticker."""
    k, first = F.expr("substr(ticker, 2)").cast("bigint") % 5, F.row_number().over(technicals.by_ticker()) == 1
    bars = t.bars.withColumn("close", F.when(first & (k == 0), F.lit(None)).when(first & (k == 1), F.lit(float("nan"))).otherwise(F.col("close")))
    return technicals.rsi(bars, 14, 10)


@query("WN3", RSI_RECURRENCE.format(p=10, what="d, ", name="rsi", join="JOIN moves USING (ticker, i)"))
def wilder_rsi_series(t):
    return technicals.rsi_series(t.bars, 10).where(F.col("rsi").isNotNull())


shared(today_quotes="""SELECT ticker, CASE WHEN h % 4 = 0 THEN last_d WHEN h % 4 = 1 THEN last_d - 5 ELSE DATE '2001-11-05' END AS d,
  price FROM (SELECT ticker, max(d) AS last_d, round(max_by(close, d) * 1.01, 6) AS price,
  CAST(substr(ticker, 2) AS BIGINT) AS h FROM bars GROUP BY ticker)""")


def today_quotes(t):
    h = F.expr("substr(ticker, 2)").cast("bigint")
    last = t.bars.groupBy("ticker").agg(F.max("d").alias("last_d"),
                                        F.round(F.max_by("close", "d") * 1.01, 6).alias("price"))
    return last.select("ticker", F.when(h % 4 == 0, F.col("last_d")).when(h % 4 == 1, F.date_sub("last_d", 5))
                       .otherwise(t.scan_date).alias("d"), "price")


@query("JN1", """
SELECT ticker, count(*) AS bars, max(d) AS as_of, round(max_by(close, d), 6) AS price, round(sum(close), 4) AS total FROM (
  SELECT b.ticker, b.d, CASE WHEN b.d = q.d THEN q.price ELSE b.close END AS close
  FROM bars b JOIN today_quotes q USING (ticker)
  UNION ALL
  SELECT q.ticker, q.d, q.price FROM today_quotes q WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = q.ticker AND b.d = q.d))
WHERE ticker IN (SELECT ticker FROM today_quotes q WHERE q.d >= (SELECT max(d) FROM bars b WHERE b.ticker = q.ticker))
GROUP BY ticker HAVING count(*) >= 60""")
def history_with_today(t):
    joined = technicals.append_today(t.bars, today_quotes(t))
    return joined.groupBy("ticker").agg(F.count("*").alias("bars"), F.max("d").alias("as_of"),
                                        F.max_by("close", "d").alias("price"),
                                        F.round(F.sum("close"), 4).alias("total"))


# ---- reconciliation and single-bar checks -------------------------------------------------------

RECONCILED_DAYS = """
day AS (SELECT ticker, d, count(*) AS n, median(close) AS m, min(provider) AS p FROM raw_bars GROUP BY 1, 2),
agree AS (SELECT r.ticker, r.d, count(*) AS k, median(r.close) AS close FROM raw_bars r JOIN day USING (ticker, d)
  WHERE abs(r.close / day.m - 1) <= 0.5 GROUP BY 1, 2),
resolved AS (SELECT day.ticker, day.d, CASE WHEN dayofweek(day.d) IN (0, 6) THEN 'weekend' WHEN n = 1 THEN 'single'
    WHEN k >= 2 THEN 'consensus' ELSE 'conflict' END AS status,
  CASE WHEN n = 1 THEN m WHEN k >= 2 THEN agree.close END AS close,
  CASE WHEN n = 1 THEN p WHEN k >= 2 THEN 'consensus' END AS source
  FROM day LEFT JOIN agree USING (ticker, d)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM resolved
  WHERE status IN ('single', 'consensus')),
"""
# The one-bar-at-a-time form of the spike rule: carry the last kept close through the series.
SPIKE_WALK = RECONCILED_DAYS + """
ahead AS MATERIALIZED (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY i) AS nxt FROM numbered),
walk AS (
  SELECT ticker, i, d, close, source, status, close AS kept, false AS spike FROM ahead WHERE i = 1
  UNION ALL
  SELECT a.ticker, a.i, a.d, a.close, a.source, a.status,
    CASE WHEN a.status = 'single' AND abs(a.close / w.kept - 1) > 0.5 AND a.nxt IS NOT NULL AND abs(a.nxt / w.kept - 1) <= 0.5
      THEN w.kept ELSE a.close END,
    coalesce(a.status = 'single' AND abs(a.close / w.kept - 1) > 0.5 AND a.nxt IS NOT NULL AND abs(a.nxt / w.kept - 1) <= 0.5, false)
  FROM walk w JOIN ahead a ON a.ticker = w.ticker AND a.i = w.i + 1)
"""


@query("DQ2 WN8", "WITH RECURSIVE " + SPIKE_WALK + """
SELECT ticker, d, round(close, 6) AS close, source, status = 'consensus' AS corroborated FROM walk WHERE NOT spike""")
def reconciled_history(t):
    return reconcile.reconcile(t.raw_bars, tolerance=0.5)


@query("DQ2 WN8", "WITH RECURSIVE " + SPIKE_WALK + """
SELECT r.ticker, count(*) FILTER (r.status IN ('single', 'consensus') AND NOT coalesce(spike, false)) AS kept,
  count(*) FILTER (r.status = 'weekend') AS dropped_weekend, count(*) FILTER (r.status = 'conflict') AS dropped_conflict,
  count(*) FILTER (coalesce(spike, false)) AS dropped_jump,
  count(*) FILTER (r.status = 'single' AND NOT spike) AS single_source,
  count(*) FILTER (r.status = 'consensus') AS corroborated
FROM resolved r LEFT JOIN walk USING (ticker, d) GROUP BY 1""")
def reconciliation_stats(t):
    return reconcile.reconcile_stats(t.raw_bars, tolerance=0.5)


@query("WN9", """SELECT ticker, d, round(close, 6) AS close,
  coalesce(close / p <= 5 AND close / p >= 0.2, true) AS plausible
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY d) AS p FROM bars)""")
def plausible_bars(t):
    return reconcile.flag_implausible(t.bars)


# ---- store rules -------------------------------------------------------------------------------

CLEAN = "dayofweek(d) NOT IN (0, 6) AND close > 0 AND source IN ('yahoo', 'stooq', 'tiingo', 'finnhub', 'twelvedata', 'alphavantage', 'consensus')"


@query("SK1 SF7", f"SELECT ticker, d, round(close, 6) AS close, source FROM price_rows WHERE {CLEAN}")
def store_clean_rows(t):
    return store.sanitize(t.price_rows).select("ticker", "d", "close", "source")


@query("SK1", f"""SELECT ticker, d, source, CASE WHEN dayofweek(d) IN (0, 6) THEN 'weekend' ELSE 'source' END AS reason
FROM price_rows WHERE NOT ({CLEAN})""")
def store_rejects(t):
    return store.rejects(t.price_rows).select("ticker", "d", "source", "reason")


@query("SK5", """SELECT ticker, d, round(close, 6) AS close, source FROM price_rows
QUALIFY row_number() OVER (PARTITION BY ticker, d ORDER BY CASE source WHEN 'consensus' THEN 0 ELSE 1 END, source, close) = 1""")
def store_trusted_rows(t):
    return store.dedupe_trusted(t.price_rows)


@query("SK2", f"""
WITH stored AS (SELECT ticker, d, close, source FROM price_rows WHERE source = 'yahoo' AND {CLEAN}),
incoming AS (SELECT ticker, d, close, source FROM price_rows WHERE source = 'consensus' AND {CLEAN})
SELECT ticker, d, round(close, 6) AS close, source FROM incoming
UNION ALL SELECT ticker, d, round(close, 6), source FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.ticker = s.ticker AND i.d = s.d)""")
def store_merged_rows(t):
    clean = store.sanitize(t.price_rows)
    return store.merge_rows(clean.where(F.col("source") == "yahoo"), clean.where(F.col("source") == "consensus"))


shared(source_quotes="""SELECT ticker, provider AS source, max_by(close, d) AS price, max(d) AS as_of,
  CASE provider WHEN 'yahoo' THEN 1 WHEN 'stooq' THEN 2 ELSE 3 END AS source_rank
  FROM raw_bars WHERE NOT (ticker LIKE '%7' AND provider <> 'yahoo') GROUP BY 1, 2""")


def source_quotes(t):
    """The latest print of every provider; a few tickers have one provider only."""
    rank = F.when(F.col("provider") == "yahoo", 1).when(F.col("provider") == "stooq", 2).otherwise(3)
    return (
        t.raw_bars.where(~(F.col("ticker").endswith("7") & (F.col("provider") != "yahoo")))
        .groupBy("ticker", F.col("provider").alias("source"))
        .agg(F.max_by("close", "d").alias("price"), F.max("d").alias("as_of"), F.first(rank).alias("source_rank")))


@query("SK3", f"""
WITH q AS (SELECT ticker, min_by(price, source_rank) AS close, min_by(as_of, source_rank) AS d,
  CASE WHEN count(*) >= 2 THEN 'consensus' ELSE min_by(source, source_rank) END AS source FROM source_quotes GROUP BY ticker)
SELECT ticker, d, round(close, 6) AS close, source FROM q WHERE {CLEAN}""")
def store_top_off(t):
    quotes = source_quotes(t).groupBy("ticker").agg(
        F.min_by("price", "source_rank").alias("price"), F.min_by("as_of", "source_rank").alias("as_of"),
        F.min_by("source", "source_rank").alias("source"), F.count("*").alias("n_sources"))
    return store.top_off(quotes)


@query("SK4", """
WITH stored AS (SELECT ticker, d, close FROM raw_bars WHERE provider = 'yahoo'),
deep AS (SELECT ticker FROM stored GROUP BY 1 HAVING count(*) >= 180)
SELECT ticker, 'db' AS src, count(*) AS bars, round(sum(close), 4) AS total FROM stored WHERE ticker IN (SELECT ticker FROM deep) GROUP BY 1
UNION ALL
SELECT ticker, 'live', count(*), round(sum(close), 4) FROM bars WHERE ticker NOT IN (SELECT ticker FROM deep) GROUP BY 1""")
def series_choice(t):
    stored = t.raw_bars.where(F.col("provider") == "yahoo").select("ticker", "d", "close")
    chosen = store.choose_series(stored, t.bars.select("ticker", "d", "close"), min_bars=180)
    return chosen.groupBy("ticker", "src").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("total"))


# ---- quality -----------------------------------------------------------------------------------

CORROBORATED = """
mid AS (SELECT ticker, median(price) AS median FROM source_quotes GROUP BY 1),
corr AS (SELECT ticker, count(*) AS n, any_value(median) AS median, (max(price) - min(price)) / any_value(median) AS spread,
  coalesce(avg(price) FILTER (abs(price / median - 1) <= 0.3), min_by(price, source_rank)) AS used,
  min_by(source, source_rank) AS primary_source, min_by(price, source_rank) AS primary_price,
  CASE WHEN count(*) >= 2 THEN (max(price) - min(price)) / any_value(median) <= 0.3 END AS ok
  FROM source_quotes JOIN mid USING (ticker) GROUP BY 1)"""


@query("DQ1", f"WITH {CORROBORATED} SELECT ticker, n, {r6('median', 'spread', 'used', 'primary_price')}, primary_source, ok FROM corr")
def corroborated_prices(t):
    return quality.corroborate(source_quotes(t), divergence=0.3)


FLAGGED = CORROBORATED + """,
pub AS (SELECT tech.ticker, tech.as_of, tech.price AS raw_price, corr.*,
  coalesce(NOT ok, false) AS diverged,
  coalesce(NOT ok AND abs(tech.price / used - 1) > 0.3, false) AS swap,
  prev.close AS prev_price
  FROM tech JOIN corr ON corr.ticker = tech.ticker
  LEFT JOIN (SELECT ticker, max_by(close, d) AS close FROM bars WHERE d < DATE '2001-06-01' GROUP BY 1) prev ON prev.ticker = tech.ticker),
fin AS (SELECT *, CASE WHEN swap THEN used ELSE raw_price END AS price FROM pub),
flagged AS (SELECT ticker, price, n, ok, list_filter([
    CASE WHEN diverged THEN 'source divergence' END, CASE WHEN swap THEN 'price moved to consensus' END,
    CASE WHEN ok IS NULL THEN 'single-source ' || primary_source END,
    CASE WHEN DATE '2001-11-05' - as_of > 30 THEN 'stale last bar' END,
    CASE WHEN abs(price / prev_price - 1) > 0.35 THEN 'jump vs last scan' END], lambda x: x IS NOT NULL) AS flags FROM fin)"""


def checked_quotes(t):
    previous = t.bars.where(F.col("d") < "2001-06-01").groupBy("ticker").agg(F.max_by("close", "d").alias("prev_price"))
    joined = t.quotes.select("ticker", "as_of", "price").join(
        quality.corroborate(source_quotes(t), divergence=0.3), "ticker").join(previous, "ticker", "left")
    return quality.integrity(joined, t.scan_date, divergence=0.3, stale_days=30)


@query("DQ3", f"WITH {FLAGGED} SELECT ticker, round(price, 6) AS price, array_to_string(flags, '; ') AS flags FROM flagged")
def quote_integrity(t):
    return checked_quotes(t).select("ticker", "price", F.array_join("flags", "; ").alias("flags"))


@query("DQ4", f"""WITH {FLAGGED},
c AS (SELECT count(*) AS total, count(*) FILTER (ticker NOT LIKE '%3') AS ok_quotes, count(*) FILTER (ticker LIKE '%3') AS errored,
 count(*) FILTER (ticker NOT LIKE '%3' AND len(flags) > 0) AS flagged,
 count(*) FILTER (ticker NOT LIKE '%3' AND regexp_matches(array_to_string(flags, ';'), 'divergence|jump|consensus')) AS bad_data,
 count(*) FILTER (ticker NOT LIKE '%3' AND ok IS NULL) AS uncorroborated,
 count(*) FILTER (ticker NOT LIKE '%3' AND ok) AS corroborated, count(*) FILTER (ticker NOT LIKE '%3') AS corroborated_of FROM flagged)
SELECT *, errored / total > 0.3 OR bad_data / ok_quotes > 0.25 OR (corroborated_of >= 3 AND corroborated / corroborated_of < 0.5) AS degraded FROM c""")
def quality_gate(t):
    """The gate of the quotes' own write: counted while they are stored, read without another scan."""
    failed = F.when(F.col("ticker").endswith("3"), "no quote")
    quotes, seen = quality.observed(checked_quotes(t).withColumn("error", failed))
    cut(quotes)
    return quality.gate_of(t.spark, seen)


@query("DQ5", """SELECT ticker, count(*) AS bars, list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(gap) // 2) + 1] AS middle_gap,
  count(*) >= 10 AND list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(gap) // 2) + 1] <= 4 AS is_daily
  FROM (SELECT ticker, CAST(d - lag(d) OVER (PARTITION BY ticker ORDER BY d) AS BIGINT) AS gap FROM theme_bars) GROUP BY 1""")
def daily_frequency(t):
    return quality.daily_frequency(t.theme_bars)


shared(common_dates="""SELECT grp, d FROM theme_bars GROUP BY grp, d
  HAVING count(*) = (SELECT count(DISTINCT ticker) FROM theme_bars x WHERE x.grp = theme_bars.grp)""")


@query("DQ6", """
WITH m AS (SELECT grp, ticker, count(*) AS bars FROM theme_bars GROUP BY 1, 2), c AS (SELECT grp, count(*) AS composite FROM common_dates GROUP BY 1)
SELECT grp, max(bars) AS deepest, min_by(ticker, bars * 1000 + CAST(substr(ticker, 2) AS INT)) AS shallow_ticker,
  min(bars) AS shallow_bars, any_value(composite) AS composite, any_value(composite) < max(bars) * 0.6 AS truncated
FROM m JOIN c USING (grp) GROUP BY grp""")
def truncation_warning(t):
    members = t.theme_bars.groupBy("grp", "ticker").agg(F.count("*").alias("bars"))
    common = align.common_dates(t.theme_bars).groupBy("grp").agg(F.count("*").alias("bars"))
    return quality.truncation(members, common)


# ---- universe ----------------------------------------------------------------------------------

shared(
    securities="""SELECT 'S' || s_suppkey AS ticker, CASE s_suppkey % 4 WHEN 0 THEN 'etf' WHEN 1 THEN 'adr' ELSE 'stock' END AS type,
      s_suppkey % 7 = 0 AS is_foreign, CASE s_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' END AS currency,
      'N' || s_nationkey AS theme FROM supplier""",
    holdings="""SELECT o_custkey AS portfolio_id, 'S' || l_suppkey AS ticker,
      CASE o_orderstatus WHEN 'F' THEN 'taxable' ELSE 'ira' END AS account,
      CASE WHEN l_suppkey % 5 = 0 THEN 'diversifier' ELSE 'deep-tech' END AS axis,
      CASE WHEN l_suppkey % 10 = 3 THEN 'Tactical de-correlator' ELSE 'core' END AS role,
      CAST(floor(sum(l_extendedprice)) AS BIGINT) AS target_usd, ['A', 'B', 'C', 'D', 'DRY'][l_suppkey % 5 + 1] AS tier
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey, 3""",
    positions="""SELECT o_custkey AS portfolio_id, 'S' || l_suppkey AS ticker, sum(l_quantity) AS shares,
      floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.2871) / 100 AS cost_basis,
      CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey % 90 AS DOUBLE) END AS forward_pe
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    names="""SELECT CASE p_size % 5 WHEN 0 THEN '(private: ' || p_name || ')' WHEN 1 THEN 'Cash ' || p_brand ELSE upper(p_name) END AS ticker FROM part""",
)


@query("PR1 SE1", """SELECT DISTINCT ticker FROM (SELECT ticker FROM holdings UNION ALL SELECT ticker FROM securities UNION ALL SELECT ticker FROM names)
WHERE ticker IS NOT NULL AND ticker <> '' AND NOT regexp_matches(ticker, '[()]') AND upper(ticker) NOT LIKE 'CASH%'""")
def tradeable_universe(t):
    size = F.col("p_size") % 5
    names = t.read("part").select(
        F.when(size == 0, F.concat(F.lit("(private: "), "p_name", F.lit(")")))
        .when(size == 1, F.concat(F.lit("Cash "), "p_brand")).otherwise(F.upper("p_name")).alias("ticker"))
    return universe.tradeable_universe(t.holdings, t.theme_members, names)


@query("PR2", """SELECT p_partkey, s, CASE s WHEN 'IVN' THEN 'IVN.TO' WHEN 'LYC' THEN 'LYC.AX' WHEN 'U.UN' THEN 'U-UN.TO' ELSE s END AS chart_symbol,
  CASE WHEN s LIKE '^%' OR contains(s, '.') THEN lower(s) ELSE lower(s) || '.us' END AS quote_symbol
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'IVN' WHEN 1 THEN 'LYC' WHEN 2 THEN 'U.UN' WHEN 3 THEN '^' || p_type
  WHEN 4 THEN upper(p_name) || '.MI' ELSE upper(p_name) END AS s FROM part)""")
def provider_symbols(t):
    k = F.col("p_size") % 6
    s = (F.when(k == 0, "IVN").when(k == 1, "LYC").when(k == 2, "U.UN").when(k == 3, F.concat(F.lit("^"), "p_type"))
         .when(k == 4, F.concat(F.upper("p_name"), F.lit(".MI"))).otherwise(F.upper("p_name")))
    return t.read("part").select("p_partkey", s.alias("s")).select(
        "p_partkey", "s", universe.chart_symbol(F.col("s")).alias("chart_symbol"),
        universe.quote_symbol(F.col("s")).alias("quote_symbol"))


@query("PR3", """SELECT event_id, CASE WHEN try_cast(s AS DOUBLE) > 0 THEN round(try_cast(s AS DOUBLE), 6) END AS price FROM
(SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'N/D' WHEN 2 THEN '-' || CAST(value AS VARCHAR) ELSE props END AS s FROM events)""")
def price_guard(t):
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.lit("N/D"))
           .when(k == 2, F.concat(F.lit("-"), F.col("value").cast("string"))).otherwise(F.col("props")))
    return t.read("events").select("event_id", positive(raw).alias("price"))


@query("PR4", """SELECT portfolio_id, ticker, account FROM (SELECT h.*, type, count(*) FILTER (type = 'etf') OVER (PARTITION BY portfolio_id) AS etfs
FROM holdings h LEFT JOIN securities USING (ticker)) WHERE type = 'etf' OR etfs < 3""")
def composite_members(t):
    return universe.composite_members(t.holdings, t.securities).select("portfolio_id", "ticker", "account")


@query("PR5", """SELECT portfolio_id, CASE WHEN axis = 'diversifier' OR regexp_matches(lower(role), 'diversifier|de-correlator') THEN 'diversifier' ELSE 'deep-tech' END AS axis,
count(*) AS holdings, CAST(sum(target_usd) AS BIGINT) AS usd FROM holdings GROUP BY 1, 2""")
def axis_split(t):
    axis = universe.sleeve_axis(F.col("axis"), F.col("role"))
    return t.holdings.groupBy("portfolio_id", axis.alias("axis")).agg(
        F.count("*").alias("holdings"), F.sum("target_usd").alias("usd"))
