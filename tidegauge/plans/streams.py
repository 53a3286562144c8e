"""Streaming jobs run over the tables until they have read all, next to the SQL of what they must come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import history, technicals
from tidegauge.plans.feeds import scratch
from tidegauge.plans.ledgers import LEDGER_DAY, anchored, day
from tidegauge.plans.registry import query
from tidegauge.session import cut
from tidegauge.streaming import jobs, lifecycle


def streamed(t, name, stream, idle=True):
    return lifecycle.collected(stream, scratch(t, name), scratch(t, f"{name}-checkpoint"), idle)


def landed(t, name, table, by):
    return lifecycle.replay(table, scratch(t, f"{name}-landing"), by)


@query("ST7", f"""
WITH c AS (SELECT * REPLACE (CASE WHEN id % 40 = 0 THEN 'gone' ELSE subject END AS subject) FROM anchored WHERE date <= DATE '{LEDGER_DAY}'),
p AS (SELECT c.*, b.close, b.close / price_at - 1 AS gain, b.d AS priced_on FROM c ASOF LEFT JOIN (SELECT * FROM bars WHERE d <= DATE '{LEDGER_DAY}') b ON b.ticker = c.subject AND b.d >= c.resolve_on),
k AS (SELECT *, coalesce(priced_on <= resolve_on + 181 AND price_at IS NOT NULL, false) AS done FROM p)
SELECT id, subject, claim, date, resolve_on, CASE WHEN done THEN 'resolved' WHEN resolve_on + 180 < DATE '{LEDGER_DAY}' THEN 'expired' ELSE 'open' END AS status,
 CASE WHEN done THEN round(gain, 6) END AS realized_return, CASE WHEN done THEN CASE claim WHEN 'up' THEN gain > 0 ELSE gain < 0 END END AS correct FROM k""")
def streamed_claims(t):
    """Claims and closes arrive by day; a timer settles what falls due. Some claims are on names never priced again."""
    claims = cut(anchored(t).where(F.col("date") <= day(t)).withColumn(
        "subject", F.when(F.col("id") % 40 == 0, "gone").otherwise(F.col("subject"))))
    last = t.read("region").limit(1).select(F.lit("~").alias("ticker"), lifecycle.heartbeat(day(t)).alias("d"), F.lit(None).cast("double").alias("close"))
    bars = t.bars.where(F.col("d") <= day(t)).select("ticker", "d", "close").unionByName(last)
    stream = lifecycle.settled_dates(landed(t, "claims", claims, "date"), landed(t, "closes", bars, "d"))
    return lifecycle.graded(claims, streamed(t, "claims", stream))


@query("ST2 SF5", """
WITH i AS (SELECT 'C' || (o_custkey % 200) AS subject, 'f' || o_orderkey AS item, 'f:C' || (o_custkey % 200) || ':' || o_orderstatus AS key, CAST(o_orderdate AS DATE) AS d FROM orders
 UNION ALL SELECT theme, 'n' || news_id, 'n:' || lower(title), date FROM news)
SELECT subject, item, d, coalesce(d - lag(d) OVER (PARTITION BY subject, key ORDER BY d, item) > 90, true) AS is_new FROM i""")
def streamed_first_seen(t):
    """Filings by their key and headlines by their title; a key is new if it was not seen for 90 days."""
    ticker = F.concat(F.lit("C"), F.col("o_custkey") % 200)
    filings = t.read("orders").select(
        ticker.alias("subject"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("item"),
        history.form_key(ticker, F.col("o_orderstatus")).alias("key"), F.to_date("o_orderdate").alias("d"))
    news = t.news.select(F.col("theme").alias("subject"), F.concat(F.lit("n"), F.col("news_id").cast("string")).alias("item"),
                         F.concat(F.lit("n:"), history.title_key(F.col("title")).cast("string")).alias("key"), F.col("date").alias("d"))
    return streamed(t, "seen", lifecycle.flag_seen(landed(t, "seen", filings.unionByName(news), "d")), idle=False)


@query("ST2 SF5", """SELECT news_id, count(*) OVER (PARTITION BY lower(title)) AS same_title,
 row_number() OVER (PARTITION BY lower(title) ORDER BY date, news_id) = 1 AS first FROM news""")
def headline_repeats(t):
    """Headlines with the number that share their title key, and whether they came first."""
    keyed = t.news.select("news_id", "date", history.title_key(F.col("title")).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("same_title"), F.min_by("news_id", F.struct("date", "news_id")).alias("head"))
    return keyed.join(groups, "key").select("news_id", "same_title", (F.col("news_id") == F.col("head")).alias("first"))


EVENTS = """m AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'proposed' END AS status, md5(c_mktsegment) AS h FROM customer WHERE c_custkey % 5 <> 0),
c AS (SELECT c_custkey AS id, md5(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE c_name END) AS h FROM customer),
v AS (SELECT id, h, CASE WHEN id % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM c WHERE id % 2 = 0)"""


@query("ST6", f"""
WITH {EVENTS},
one AS (SELECT c.id * 10 AS n, c.id, m.id IS NULL OR (m.status = 'rejected' AND m.h <> c.h) AS fresh FROM c LEFT JOIN m USING (id)),
k AS (SELECT c.id, CASE WHEN c.id % 8 = 0 THEN md5(c.h) ELSE c.h END AS h, coalesce(v.status, m.status) AS status, CASE WHEN v.id IS NOT NULL THEN v.h ELSE m.h END AS past FROM c LEFT JOIN v USING (id) LEFT JOIN m USING (id))
SELECT n, CAST(id AS VARCHAR) AS id, fresh FROM one UNION ALL
SELECT 100000000 + id, CAST(id AS VARCHAR), status IS NULL OR (status = 'rejected' AND past <> h) FROM k""")
def streamed_candidates(t):
    """Two scans of the same candidates with verdicts between them, on a memory that is there from the start. The second
    scan brings other evidence for every eighth one."""
    c, k = t.read("customer"), F.col("c_custkey")
    name = k.cast("string").alias("id")
    proof = F.md5(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).cast("binary"))
    memory = c.where(k % 5 != 0).select(name, F.when(k % 3 == 0, "rejected").when(k % 3 == 1, "accepted").otherwise("proposed").alias("status"),
                                        F.md5(F.col("c_mktsegment").cast("binary")).alias("evidence_hash"))
    scan = lambda n, evidence, d: c.select(n.cast("long").alias("n"), name, F.lit(None).cast("string").alias("status"),
                                           evidence.alias("evidence_hash"), F.lit(d).cast("date").alias("d"))
    verdicts = c.where(k % 2 == 0).select((k * 10 + 1).alias("n"), name, F.when(k % 4 == 0, "rejected").otherwise("accepted").alias("status"),
                                          proof.alias("evidence_hash"), F.lit("2001-01-02").cast("date").alias("d"))
    again = F.when(k % 8 == 0, F.md5(proof.cast("binary"))).otherwise(proof)
    events = scan(k * 10, proof, "2001-01-01").unionByName(verdicts).unionByName(scan(k + 100_000_000, again, "2001-01-03"))
    return streamed(t, "memory", lifecycle.recall_candidates(landed(t, "memory", events, "d"), memory))


@query("ST3", """
WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, event_id) AS i FROM ticks),
w AS (SELECT ticker, i, price AS last, true AS ok FROM b WHERE i = 1
 UNION ALL SELECT b.ticker, b.i, CASE WHEN b.price / last BETWEEN 0.2e0 AND 5e0 THEN b.price ELSE last END, b.price / last BETWEEN 0.2e0 AND 5e0 FROM w JOIN b ON b.ticker = w.ticker AND b.i = w.i + 1)
SELECT ticker, event_id, round(price, 6) AS price, ok AS accepted FROM w JOIN b USING (ticker, i)""")
def streamed_guard(t):
    ticks = t.ticks.select("ticker", "event_id", F.col("ts").cast("timestamp").alias("ts"), "price", F.to_date("ts").alias("day"))
    stream = jobs.guard_stream(landed(t, "ticks", ticks, "day").drop("day"))
    return streamed(t, "guard", stream).select("ticker", "event_id", "price", "accepted")


@query("ST4 ST5", """
WITH m AS (SELECT ticker AS trigger, d, pct_off_high <= -0.9 AS met FROM tech_series),
f AS (SELECT *, met AND coalesce(lag(met) OVER w, false) AS fired, met AND NOT coalesce(lag(met) OVER w, false) AS pending FROM m WINDOW w AS (PARTITION BY trigger ORDER BY d))
SELECT trigger, d, met, fired, pending, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY trigger ORDER BY d), false) AS newly_fired FROM f""")
def streamed_triggers(t):
    scans = technicals.series(t.bars).select(F.col("ticker").alias("trigger"), "d", (F.col("pct_off_high") <= -0.9).alias("met"))
    return streamed(t, "triggers", jobs.trigger_stream(landed(t, "triggers", scans, "d")))
