"""Queries over votes, evidence, proposals and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import diversify, signals, validate, votes

from tidegauge.plans.registry import query, shared
from tidegauge.plans.tables import BIND_LEVELS, PRICED_LEVELS, pick
from tidegauge.plans.themes import theme_strength

shared(
    seats="""SELECT doc_id AS item, unnest([{'s': 'bull', 'v': CASE WHEN doc_id % 10 = 0 THEN NULL WHEN quality = 1 THEN 'medium' ELSE 'low' END}, {'s': 'bear', 'v': CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 1 THEN 'crowded' ELSE 'medium' END},
      {'s': 'skeptic', 'v': CASE WHEN n_chars % 7 < 4 THEN NULL ELSE ['low', 'medium', 'high', 'odd'][n_chars % 4 + 1] END}]) AS x FROM labels JOIN documents USING (doc_id)""",
    votes="SELECT item, x.s AS seat, x.v AS value FROM seats",
)


def vote_table(t):
    n = F.col("n_chars")
    seats = F.explode(F.create_map(
        F.lit("bull"), F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("quality") == 1, "medium").otherwise("low"),
        F.lit("bear"), F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("toxic") == 1, "crowded").otherwise("medium"),
        F.lit("skeptic"), F.when(n % 7 >= 4, pick(["low", "medium", "high", "odd"], n % 4)))).alias("seat", "value")
    return t.read("labels").join(t.read("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("item"), seats)


@query("AG20", """
WITH c AS (SELECT item, value, count(*) AS c FROM votes WHERE value IN ('low', 'medium', 'high', 'crowded') GROUP BY 1, 2)
SELECT item, coalesce(n, 0) AS n, value, coalesce(agreement, 0e0) AS agreement, coalesce(level, 'wide') AS level FROM (SELECT DISTINCT item FROM votes) LEFT JOIN (SELECT item, CAST(sum(c) AS BIGINT) AS n, CASE WHEN max(c) > sum(c) / 2 THEN max_by(value, c) END AS value, floor(max(c) / sum(c) * 100 + 0.5e0) / 100 AS agreement,
 CASE WHEN count(*) = 1 THEN 'tight' WHEN max(c) > sum(c) / 2 THEN 'moderate' ELSE 'wide' END AS level FROM c GROUP BY 1) USING (item)""")
def vote_consensus(t):
    return votes.consensus(vote_table(t))


@query("AG25", """SELECT *, items > 0 AND (bear <= items / 2 OR skeptic <= items / 2) AS degraded FROM (SELECT count(DISTINCT item) AS items, count(DISTINCT item) FILTER (seat = 'bull' AND value IS NOT NULL) AS bull,
 count(DISTINCT item) FILTER (seat = 'bear' AND value IS NOT NULL) AS bear, count(DISTINCT item) FILTER (seat = 'skeptic' AND value IS NOT NULL) AS skeptic FROM votes)""")
def panel_health(t):
    return votes.panel_health(vote_table(t))


shared(replies="""SELECT conv_id, turn, 'note {"step": ' || turn || '} from ' || role || CASE (conv_id + turn) % 4 WHEN 0 THEN ' {"met": true, "confidence": ' || CAST((turn % 5) * 3 AS VARCHAR) || '.5, "citations": ["a", "b"]}'
  WHEN 1 THEN ' {"met": false, "confidence": 0.4, "rationale": "' || role || '"}' WHEN 2 THEN ' no json' ELSE ' {"met": "yes", "confidence": "0.7"}' END AS text FROM conversations""")


def replies(t):
    k = (F.col("conv_id") + F.col("turn")) % 4
    tail = (
        F.when(k == 0, F.concat(F.lit(' {"met": true, "confidence": '), ((F.col("turn") % 5) * 3).cast("string"), F.lit('.5, "citations": ["a", "b"]}')))
        .when(k == 1, F.concat(F.lit(' {"met": false, "confidence": 0.4, "rationale": "'), "role", F.lit('"}')))
        .when(k == 2, " no json").otherwise(' {"met": "yes", "confidence": "0.7"}'))
    head = F.concat(F.lit('note {"step": '), F.col("turn").cast("string"), F.lit("} from "), "role")
    return t.read("conversations").select("conv_id", "turn", F.concat(head, tail).alias("text"))


@query("SF10", """SELECT conv_id, turn, (conv_id + turn) % 4 = 0 AS met, CASE (conv_id + turn) % 4 WHEN 0 THEN least(1e0, (turn % 5) * 3 + 0.5e0) WHEN 1 THEN 0.4e0 WHEN 2 THEN 0e0 ELSE 0.7e0 END AS confidence,
 CASE (conv_id + turn) % 4 WHEN 0 THEN 'a|b' ELSE '' END AS citations, CASE (conv_id + turn) % 4 WHEN 1 THEN regexp_extract(text, '"rationale": "([a-z]*)"', 1) ELSE '' END AS rationale FROM replies""")
def parsed_verdicts(t):
    v = replies(t).withColumn("v", votes.parse_verdict(F.col("text")))
    return v.select("conv_id", "turn", "v.met", "v.confidence", F.array_join("v.citations", "|").alias("citations"), "v.rationale")


shared(
    seat_verdicts="""SELECT source AS trigger, doc_id, CASE WHEN doc_id % 13 = 0 OR CAST(substr(source, 4) AS INT) % 10 = 9 THEN NULL ELSE quality = 1 AND CAST(substr(source, 4) AS INT) % 5 > 0 END AS met, 0.3e0 + (CAST(substr(source, 4) AS INT) % 6) / 10e0 AS confidence FROM labels JOIN documents USING (doc_id)""",
    trigger_evidence="""SELECT source AS trigger, count(*) FILTER (lang = 'es' AND CAST(substr(source, 4) AS INT) % 2 = 0) AS filings, count(DISTINCT lang) FILTER (CAST(substr(source, 4) AS INT) % 3 = 0) AS news FROM documents GROUP BY 1""",
)


def seat_verdicts(t):
    k = F.expr("substr(source, 4)").cast("int")
    met = F.when((F.col("doc_id") % 13 != 0) & (k % 10 != 9), (F.col("quality") == 1) & (k % 5 > 0))
    return t.read("labels").join(t.read("documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("trigger"), met.alias("met"), (0.3 + (k % 6) / 10.0).alias("confidence"))


def trigger_evidence(t):
    k = F.expr("substr(source, 4)").cast("int")
    return t.read("documents").groupBy(F.col("source").alias("trigger")).agg(
        F.count_if((F.col("lang") == "es") & (k % 2 == 0)).alias("filings"),
        F.count_distinct(F.when(k % 3 == 0, F.col("lang"))).alias("news"))


CONSENSUS = """
v AS (SELECT trigger, count(met) AS seats, count(*) FILTER (met) AS met_seats, coalesce(floor(avg(confidence) FILTER (met) * 100 + 0.5e0) / 100, 0) AS confidence FROM seat_verdicts WHERE met IS NOT NULL GROUP BY 1),
k AS (SELECT trigger, coalesce(seats, 0) AS seats, coalesce(met_seats, 0) AS met_seats, coalesce(confidence, 0) AS confidence FROM trigger_evidence LEFT JOIN v USING (trigger)),
j AS (SELECT v.*, seats > 0 AND (filings >= 1 OR news >= 2) AS corroborated, met_seats * 2 > seats AS majority, CASE WHEN CAST(substr(trigger, 4) AS INT) % 4 = 0 THEN 'likely-met' ELSE 'monitoring' END AS prev FROM k v JOIN trigger_evidence USING (trigger)),
m AS (SELECT *, met_seats >= 2 AND majority AND corroborated AND confidence >= 0.6 AS met FROM j),
c AS (SELECT trigger, CASE WHEN met AND prev IN ('likely-met', 'fired') THEN 'fired' WHEN met THEN 'likely-met' WHEN majority OR confidence >= 0.4 THEN 'approaching' ELSE 'monitoring' END AS status, met,
 round(confidence, 6) AS confidence, seats, met_seats, corroborated FROM m)"""


def consensus(t):
    k = F.expr("substr(source, 4)").cast("int")
    previous = t.read("documents").select(F.col("source").alias("trigger"), F.when(k % 4 == 0, "likely-met").otherwise("monitoring").alias("status")).distinct()
    return votes.catalyst_consensus(seat_verdicts(t), trigger_evidence(t), previous)


@query("AG21", f"WITH {CONSENSUS} SELECT * FROM c")
def catalyst_status(t):
    return consensus(t)


@query("TX5", f"""WITH {CONSENSUS} SELECT trigger, status, CASE WHEN status IN ('fired', 'likely-met') THEN 'trim ' || trigger || ' Current weight ~' || format('{{:.1f}}', (CAST(substr(trigger, 4) AS INT) + 1) * 1e0) || '%. Regime: defensive.' END AS suggestion FROM c""")
def catalyst_actions(t):
    k = F.expr("substr(trigger, 4)").cast("int")
    text = votes.suggested_action(F.concat(F.lit("trim "), "trigger"), (k + 1) / 100.0, F.lit("defensive"))
    return consensus(t).select("trigger", "status", F.when(F.col("status").isin("fired", "likely-met"), text).alias("suggestion"))


shared(
    evidence="""SELECT theme, coalesce(news, 0) AS news, coalesce(news_with_excerpt, 0) AS news_with_excerpt, coalesce(filings, 0) AS filings, coalesce(filing_passages, 0) AS filing_passages
      FROM themes LEFT JOIN (SELECT theme, count(*) AS news, count(*) FILTER (title <> '' AND news_id % 3 = 0) AS news_with_excerpt FROM news GROUP BY 1) USING (theme)
      LEFT JOIN (SELECT 'N' || (doc_id % 23) AS theme, count(*) AS filings, CAST(sum(n_chars % 3) AS BIGINT) AS filing_passages FROM documents GROUP BY 1) USING (theme)""",
    tape="""SELECT theme, count(*) AS quoted, avg(coalesce(mom_1m, 0)) + avg(coalesce(pct_vs_ma200, 0)) AS momentum, bool_or(coalesce(ytd >= 0.5, false) OR coalesce(pct_vs_ma200 >= 0.2, false)) AS extended
      FROM theme_members JOIN tech USING (ticker) GROUP BY 1""",
    flags="""SELECT theme, CASE WHEN priced_in IN ('high', 'crowded') AND rs <= -0.03e0 THEN 'de-rating' WHEN priced_in IN ('low', 'medium') AND rs >= 0.03e0 THEN 'inflecting' ELSE 'none' END AS flag FROM themes LEFT JOIN theme_rs USING (theme)""",
)


def evidence(t):
    news = t.news.withColumn("excerpt", F.when(F.col("news_id") % 3 == 0, F.col("title")))
    filings = t.read("documents").select(F.concat(F.lit("N"), F.col("doc_id") % 23).alias("theme"), (F.col("n_chars") % 3).alias("passages"))
    return votes.evidence_counts(t.themes, news, filings)


@query("AG24", """
WITH r AS (SELECT theme, 'news' AS lane, news_id AS id, date, title AS body FROM news
 UNION ALL SELECT 'N' || (doc_id % 23), 'filing', doc_id, NULL, left(trim(text), 240) FROM documents)
SELECT theme, lane, id, date, body, row_number() OVER (PARTITION BY theme, lane ORDER BY date DESC NULLS LAST, id) AS place FROM r WHERE length(body) > 0
QUALIFY place <= 12""")
def evidence_rows(t):
    """The latest headlines of each theme and the openings of its filings."""
    news = t.news.select("theme", F.col("news_id").alias("id"), "date", F.col("title").alias("body"))
    filings = t.read("documents").select(F.concat(F.lit("N"), F.col("doc_id") % 23).alias("theme"), F.col("doc_id").alias("id"),
                                         F.lit(None).cast("date").alias("date"), F.substring(F.trim("text"), 1, 240).alias("body"))
    return votes.evidence_rows(news, filings).withColumn("place", F.col("place").cast("bigint"))


@query("AG24", "SELECT * FROM evidence")
def evidence_counts(t):
    return evidence(t)


@query("AG22", """SELECT theme, lean, news_lane, filing_passages AS filings_lane, CASE WHEN NOT (filing_passages > 0 OR news_lane > 0 OR coalesce(quoted, 0) > 0) THEN 'thin-evidence'
 WHEN priced_in IN ('high', 'crowded') AND lean = 'weak' THEN 'fundamentals-vs-price' END AS divergence FROM (
SELECT *, CASE WHEN flag = 'de-rating' OR coalesce(momentum, 0) < -0.05 THEN 'weak' WHEN coalesce(momentum, 0) > 0.05 THEN 'strong' ELSE 'neutral' END AS lean,
 CASE WHEN news_with_excerpt > 0 THEN news_with_excerpt ELSE news END AS news_lane FROM themes JOIN flags USING (theme) JOIN evidence USING (theme) LEFT JOIN tape USING (theme))""")
def evidence_triangulation(t):
    flag = t.themes.join(theme_strength(t), "theme", "left").withColumn(
        "flag", signals.derating_flag(F.col("priced_in"), F.col("rs")))
    rows = flag.join(evidence(t), "theme").join(votes.member_tape(t.theme_members, t.quotes), "theme", "left")
    return votes.triangulate(rows).select("theme", "lean", "news_lane", "filings_lane", "divergence")


shared(
    edits="""SELECT theme, ['low', 'medium', 'high', 'crowded', 'odd'][k % 5 + 1] AS new_priced_in, ['now', '2027', '2028-29', '2030+', 'physics-floor'][(k * 3) % 5 + 1] AS new_bind_window,
      CASE WHEN k % 3 = 0 THEN k % 2 = 1 END AS new_non_consensus, CASE k % 6 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.55e0 WHEN 2 THEN 1.4e0 WHEN 3 THEN 0.3e0 ELSE 0.7e0 END AS raw_conf,
      'Prefer ' || substr(sector, 1, 4) || ' over ' || CASE WHEN k % 4 = 0 THEN 'ZZQ and CEO' ELSE 'CFO' END AS variant_view, sector AS coverage, k % 8 <> 7 AS answered,
      CASE k % 5 WHEN 0 THEN 'revise' WHEN 1 THEN 'veto' ELSE 'approve' END AS review, CASE WHEN k % 5 = 0 THEN -0.3e0 ELSE 0.2e0 END AS review_adj
      FROM (SELECT *, CAST(substr(theme, 2) AS INT) AS k FROM themes)""",
    verified="""SELECT *, (CASE WHEN earlier THEN 0.1e0 ELSE 0 END) + len(unknown) * 0.05e0 AS pen, contra OR thin AS hard_fail FROM (
      SELECT *, coalesce(list_position(['low', 'medium', 'high', 'crowded'], new_priced_in) < list_position(['low', 'medium', 'high', 'crowded'], priced_in) AND extended, false) AS contra,
      coalesce(list_position(['now', '2027', '2028-29', '2030+', 'physics-floor'], new_bind_window) < list_position(['now', '2027', '2028-29', '2030+', 'physics-floor'], bind_window), false) AS earlier,
      news_with_excerpt + filing_passages = 0 AND confidence >= 0.65 AS thin,
      list_filter(list_distinct(regexp_extract_all(variant_view, '\\b[A-Z]{2,5}\\b')), lambda w: NOT list_contains(regexp_extract_all(coverage, '[A-Z]{2,5}'), w) AND w NOT IN ('CEO', 'CFO', 'US', 'EU')) AS unknown FROM (
      SELECT t.theme, priced_in, bind_window, non_consensus, CASE WHEN new_priced_in <> 'odd' THEN new_priced_in END AS new_priced_in, new_bind_window, new_non_consensus, least(1, raw_conf) AS confidence, variant_view, coverage, answered, review, review_adj,
       coalesce(extended, false) AS extended, CASE WHEN CAST(substr(t.theme, 2) AS INT) % 9 = 0 THEN 0 ELSE news_with_excerpt END AS news_with_excerpt, CASE WHEN CAST(substr(t.theme, 2) AS INT) % 9 = 0 THEN 0 ELSE filing_passages END AS filing_passages
      FROM themes t JOIN edits USING (theme) JOIN evidence USING (theme) LEFT JOIN tape USING (theme)))""",
)


def edits(t):
    k = F.expr("substr(theme, 2)").cast("int")
    conf = F.when(k % 6 == 0, 0.9).when(k % 6 == 1, 0.55).when(k % 6 == 2, 1.4).when(k % 6 == 3, 0.3).otherwise(0.7)
    raw = t.themes.select(
        "theme", pick([*PRICED_LEVELS, "odd"], k % 5).alias("priced_in"), pick(BIND_LEVELS, (k * 3) % 5).alias("bind_window"),
        F.when(k % 3 == 0, k % 2 == 1).alias("non_consensus"), conf.alias("confidence"), "kill_condition", "kill_by",
        F.concat(F.lit("Prefer "), F.substring("sector", 1, 4), F.lit(" over "), F.when(k % 4 == 0, "ZZQ and CEO").otherwise("CFO")).alias("variant_view"),
        F.col("sector").alias("coverage"), (k % 8 != 7).alias("answered"),
        F.when(k % 5 == 0, "revise").when(k % 5 == 1, "veto").otherwise("approve").alias("review"),
        F.when(k % 5 == 0, -0.3).otherwise(0.2).alias("review_adj"))
    return votes.sanitize_edit(raw)


def verified(t):
    e = edits(t).withColumnsRenamed({f: f"new_{f}" for f in votes.FIELDS}).drop("kill_condition", "kill_by")
    bare = F.expr("substr(theme, 2)").cast("int") % 9 == 0
    rows = (t.themes.select("theme", *votes.FIELDS).join(e, "theme").join(evidence(t), "theme")
            .join(votes.member_tape(t.theme_members, t.quotes), "theme", "left")
            .withColumns({c: F.when(bare, 0).otherwise(F.col(c)) for c in ("news_with_excerpt", "filing_passages")}))
    return votes.verify(rows)


@query("AG23", """SELECT theme, round(pen, 6) AS penalty, hard_fail, array_to_string(list_sort(list_filter(list_concat([CASE WHEN contra THEN 'price-contradiction' END, CASE WHEN earlier THEN 'bind-acceleration' END],
 list_transform(unknown, lambda w: 'unverified-ticker ' || w), [CASE WHEN thin THEN 'thin-evidence-overconfident' END]), lambda x: x IS NOT NULL)), '; ') AS flags FROM verified""")
def proposal_checks(t):
    return verified(t).select("theme", "penalty", "hard_fail", F.array_join(F.array_sort("flags"), "; ").alias("flags"))


@query("AG29", """
WITH a AS (SELECT *, coalesce(new_priced_in <> priced_in, false) OR coalesce(new_bind_window <> bind_window, false) OR coalesce(new_non_consensus <> non_consensus, false) AS changed,
 CASE WHEN pen > 0 THEN floor(greatest(0, confidence - pen) * 1000 + 0.5e0) / 1000 ELSE confidence END AS c1 FROM verified),
b AS (SELECT *, CASE review WHEN 'revise' THEN floor(greatest(0, c1 + least(0, review_adj)) * 1000 + 0.5e0) / 1000 ELSE c1 END AS c2, changed AND c1 >= 0.5 AS cand FROM a)
SELECT theme, CASE WHEN NOT answered THEN 'no-response' WHEN hard_fail THEN 'verification-failed' WHEN cand AND review = 'veto' THEN 'vetoed' WHEN cand AND c2 >= 0.5 THEN 'proposal' WHEN NOT changed THEN 'no-change' ELSE 'below-confidence' END AS outcome,
 round(CASE WHEN cand THEN c2 ELSE c1 END, 6) AS confidence FROM b""")
def decision_funnel(t):
    return votes.decide(verified(t))


@query("AG26", """SELECT c_mktsegment, round(coalesce(avg(v), 0.6e0), 6) AS conviction, count(v) AS votes FROM (
SELECT c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN least(1, floor(abs(c_acctbal) / 10) / 1000) WHEN 1 THEN 0.35e0 WHEN 2 THEN NULL ELSE 1e0 END AS v FROM customer) GROUP BY 1""")
def segment_conviction(t):
    k = F.col("c_custkey") % 4
    share = F.format_string("%.4f", F.floor(F.abs("c_acctbal") / 10) / 1000)
    text = (F.when(k == 0, F.concat(F.lit('{"conviction": '), share, F.lit("}")))
            .when(k == 1, "about 0.35 I think").when(k == 2, "no idea").otherwise('{"Conviction" : 7}'))
    return diversify.conviction(t.read("customer").select("c_mktsegment", text.alias("text")), "c_mktsegment")


# ---- proposals -----------------------------------------------------------------------------------------

shared(props="SELECT theme, new_priced_in AS priced_in, new_bind_window AS bind_window, new_non_consensus AS non_consensus FROM edits WHERE answered")


@query("JN10", """SELECT theme, 'priced_in' AS field, t.priced_in AS from_value, p.priced_in AS to_value FROM themes t JOIN props p USING (theme) WHERE p.priced_in <> t.priced_in AND p.priced_in <> 'odd'
UNION ALL SELECT theme, 'bind_window', t.bind_window, p.bind_window FROM themes t JOIN props p USING (theme) WHERE p.bind_window <> t.bind_window
UNION ALL SELECT theme, 'non_consensus', CAST(t.non_consensus AS VARCHAR), CAST(p.non_consensus AS VARCHAR) FROM themes t JOIN props p USING (theme) WHERE p.non_consensus <> t.non_consensus""")
def proposal_diffs(t):
    return votes.proposal_diffs(edits(t).where("answered"), t.themes)


@query("JN11", """SELECT theme, CASE WHEN p.priced_in <> 'odd' THEN p.priced_in ELSE t.priced_in END AS priced_in, coalesce(p.bind_window, t.bind_window) AS bind_window, coalesce(p.non_consensus, t.non_consensus) AS non_consensus,
 CASE WHEN (p.priced_in <> t.priced_in AND p.priced_in <> 'odd') OR p.bind_window <> t.bind_window OR p.non_consensus <> t.non_consensus THEN DATE '2001-11-05' END AS last_reviewed FROM themes t LEFT JOIN props p USING (theme)""")
def accepted_themes(t):
    current = t.themes.withColumn("last_reviewed", F.lit(None).cast("date"))
    return votes.accept_proposals(current, edits(t).where("answered"), t.scan_date).select(
        "theme", *votes.FIELDS, "last_reviewed")


@query("JN11", """SELECT theme, scarcity, bind_window, priced_in, durability, substitution_risk, non_consensus, NULL::DATE AS last_reviewed, 'curated' AS source FROM themes
UNION ALL SELECT 'scout-' || p_brand, p_brand, '2027', CASE WHEN min(p_size) % 2 = 0 THEN 'high' ELSE 'low' END, 'medium', 'medium', true, DATE '2001-11-05', 'scout' FROM part GROUP BY p_brand""")
def themes_with_candidates(t):
    brands = t.read("part").groupBy("p_brand").agg(F.min("p_size").alias("s")).select(
        F.concat(F.lit("scout-"), "p_brand").alias("theme"), F.lit(None).cast("string").alias("sector"),
        F.col("p_brand").alias("scarcity"), F.lit("soon").alias("bind_window"),
        F.when(F.col("s") % 2 == 0, "high").otherwise("pricey").alias("priced_in"),
        *[F.lit(None).cast("string").alias(c) for c in ("durability", "substitution_risk")],
        F.lit(None).cast("boolean").alias("non_consensus"))
    known = t.themes.select("theme", "sector", "scarcity", "bind_window", "priced_in", "durability", "substitution_risk", "non_consensus")
    current = t.themes.withColumn("last_reviewed", F.lit(None).cast("date"))
    return votes.append_themes(current, brands.unionByName(known), t.scan_date).drop("sector")


@query("JN11", """WITH e AS (SELECT DISTINCT p_type AS phrase, CASE WHEN length(p_type) % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM part),
g AS (SELECT DISTINCT lower(x) AS phrase FROM (SELECT p_type AS x FROM part UNION ALL SELECT p_name FROM part))
SELECT phrase, status FROM e UNION ALL SELECT phrase, 'pending' FROM g WHERE phrase NOT IN (SELECT lower(phrase) FROM e)""")
def merged_phrases(t):
    part = t.read("part")
    existing = part.select(F.col("p_type").alias("phrase")).distinct().withColumns({
        "status": F.when(F.length("phrase") % 2 == 0, "approved").otherwise("rejected"), "added": F.lit("2001-01-01").cast("date")})
    generated = part.select(F.lower("p_type").alias("phrase")).unionByName(part.select(F.lower("p_name").alias("phrase")))
    return votes.merge_phrases(existing, generated, t.scan_date).select("phrase", "status")


@query("JN11", """WITH e AS (SELECT DISTINCT p_type AS phrase, CASE WHEN length(p_type) % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM part),
g AS (SELECT DISTINCT lower(x) AS phrase FROM (SELECT p_type AS x FROM part UNION ALL SELECT p_name FROM part))
SELECT phrase, status FROM e UNION ALL SELECT phrase, 'approved' FROM g WHERE phrase NOT IN (SELECT lower(phrase) FROM e)""")
def approved_pending(t):
    """The phrase list after a reviewer has approved what was pending; rejected phrases stay rejected."""
    return votes.approve_pending(merged_phrases(t))


# ---- validation ------------------------------------------------------------------------------------------

@query("VL1", """SELECT portfolio_id, ticker, error FROM (SELECT portfolio_id, ticker, unnest(list_filter([CASE WHEN account = 'taxable' AND k % 9 = 0 THEN 'account' END,
 CASE WHEN k % 8 = 1 THEN 'tier required' END, CASE WHEN k % 11 = 2 THEN 'target_usd must be a number' END, CASE WHEN k % 6 = 5 THEN 'axis' END], lambda x: x IS NOT NULL)) AS error
 FROM (SELECT *, CAST(substr(ticker, 2) AS INT) AS k FROM holdings))""")
def holding_errors(t):
    k = F.expr("substr(ticker, 2)").cast("int")
    bad = t.holdings.withColumns({
        "account": F.when((F.col("account") == "taxable") & (k % 9 == 0), "cash").otherwise(F.col("account")),
        "tier": F.when(k % 8 == 1, "").otherwise(F.col("tier")),
        "target_usd": F.when(k % 11 == 2, F.lit(float("nan"))).otherwise(F.col("target_usd").cast("double")),
        "axis": F.when(k % 6 == 5, "other").when(k % 6 == 4, None).otherwise(F.col("axis"))})
    return validate.holdings(bad)


@query("VL1", """SELECT 'S' || s_suppkey AS ticker, 'type' AS error FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'P' || portfolio_id || ticker, 'shares must be a number' FROM positions WHERE CAST(substr(ticker, 2) AS INT) % 25 = 0""")
def registry_errors(t):
    k = F.expr("substr(ticker, 2)").cast("int")
    types = validate.securities(t.securities.withColumn("type", F.when(k % 10 == 0, "fund").otherwise(F.col("type"))))
    shares = validate.positions(t.positions.withColumn("shares", F.when(k % 25 == 0, F.lit(float("nan"))).otherwise(F.col("shares"))))
    return types.unionByName(shares.select(F.concat(F.lit("P"), "portfolio_id", "ticker").alias("ticker"), "error"))


@query("VL2", """SELECT theme, error FROM (SELECT theme, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'sector required' END, CASE WHEN k % 7 = 0 THEN 'bind_window' END, CASE WHEN k % 6 = 1 THEN 'confidence must be 0..1' END,
 CASE WHEN k % 10 = 3 THEN 'last_reviewed must be a date' END], lambda x: x IS NOT NULL)) AS error FROM (SELECT *, CAST(substr(theme, 2) AS INT) AS k FROM themes WHERE theme <> 'N2'))
UNION ALL SELECT theme, error FROM (VALUES ('N2', 'duplicate id')) v(theme, error)""")
def theme_errors(t):
    k = F.expr("substr(theme, 2)").cast("int")
    bad = t.themes.withColumns({
        "sector": F.when(k % 5 == 0, "").otherwise(F.col("sector")),
        "bind_window": F.when(k % 7 == 0, "later").otherwise(F.col("bind_window")),
        "confidence": F.when(k % 6 == 1, 1.2).otherwise(0.5),
        "last_reviewed": F.when(k % 10 == 3, "soon").otherwise("2001-05-05")})
    return validate.themes(bad.unionByName(bad.where(F.col("theme") == "N2")))


@query("VL3", """SELECT trigger, error FROM (SELECT trigger, unnest(list_filter([CASE WHEN k % 4 = 0 THEN 'type' END, CASE WHEN k % 6 = 0 THEN 'status' END, CASE WHEN k % 5 = 0 THEN 'threshold must be a number' END], lambda x: x IS NOT NULL)) AS error
 FROM (SELECT DISTINCT source AS trigger, CAST(substr(source, 4) AS INT) AS k FROM documents))
UNION ALL SELECT ticker, 'price or error required' FROM tech WHERE ticker LIKE '%4' UNION ALL SELECT ticker, 'posture' FROM tech WHERE ticker LIKE '%6'""")
def trigger_errors(t):
    k = F.expr("substr(trigger, 4)").cast("int")
    rows = t.read("documents").select(F.col("source").alias("trigger")).distinct().withColumns({
        "name": F.col("trigger"), "type": F.when(k % 4 == 0, "robot").otherwise("manual"),
        "status": F.when(k % 6 == 0, "idle").otherwise("armed"), "action": F.lit("review"),
        "threshold": F.when(k % 5 == 0, "high").otherwise("0.2")})
    quotes = t.quotes.select("ticker", F.when(~F.col("ticker").endswith("4"), F.col("price")).alias("price"),
                             F.lit(None).cast("string").alias("error"), F.when(F.col("ticker").endswith("6"), "bullish").alias("posture"))
    return validate.triggers(rows).unionByName(validate.quotes(quotes).withColumnRenamed("ticker", "trigger"))


@query("VL4", """SELECT theme, CASE WHEN new_priced_in <> 'odd' THEN new_priced_in END AS priced_in, new_bind_window AS bind_window, new_non_consensus AS non_consensus, least(1, raw_conf) AS confidence,
 CASE WHEN kill_by <> 'someday' THEN kill_by END AS kill_by FROM edits JOIN themes USING (theme)""")
def sanitized_edits(t):
    return edits(t).select("theme", *votes.FIELDS, "confidence", "kill_by")


@query("VL4", "SELECT DISTINCT ticker FROM holdings WHERE ticker NOT IN (SELECT ticker FROM tech) OR ticker LIKE '%5'")
def unresolved_holdings(t):
    published = t.quotes.where(~F.col("ticker").endswith("5")).select("ticker", "price", F.lit(None).cast("string").alias("error"))
    return validate.unresolved(t.holdings, published)
