"""Queries over text: sweeps, proxies, news, passages and the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.operators import leads
from tidegauge.plans.registry import query, shared

PHRASES = ["orantion", "thanedble", "tiontion", "of the", "worthless", "pathetic", "hetition", "engeber", "for that", "euxtion"]
PL = ", ".join(f"'{p}'" for p in PHRASES)

shared(
    filings="SELECT doc_id, upper(source) AS filer, text FROM documents",
    hits=f"""SELECT filer, phrase, count(*) AS mentions FROM filings, (SELECT unnest([{PL}]) AS phrase) WHERE contains(lower(text), phrase) GROUP BY 1, 2""",
    clusters="""SELECT filer, count(*) AS phrase_count, CAST(sum(mentions) AS BIGINT) AS mentions, array_to_string(list_sort(list(phrase)), ', ') AS phrases,
      floor((count(*) + least(0.99e0, ln(1 + sum(mentions)) / 10)) * 1000 + 0.5e0) / 1000 AS score FROM hits WHERE filer NOT IN ('SRC0', 'SRC7') GROUP BY 1 HAVING count(*) >= 2""",
    tally="""SELECT chokepoint, filer AS ticker, CAST(sum(mentions) AS BIGINT) AS mentions FROM hits JOIN (SELECT phrase, 'C' || (length(phrase) % 4) AS chokepoint FROM (SELECT DISTINCT phrase FROM hits)) USING (phrase)
      GROUP BY 1, 2""",
    specific="""SELECT chokepoint, ticker, mentions, floor(sqrt(mentions / max(mentions) OVER (PARTITION BY chokepoint)) / count(*) OVER (PARTITION BY ticker) * 1000 + 0.5e0) / 1000 AS score,
      count(*) OVER (PARTITION BY ticker) > (SELECT count(DISTINCT chokepoint) FROM tally) / 2 AS generic FROM tally""",
)


def phrase_table(t):
    """Reviewed phrases: the list the corpus is swept for, plus one still pending."""
    words = F.explode(F.array(*[F.lit(p) for p in PHRASES], F.lit("pending words")))
    one = t.read("region").agg(F.count("*").alias("n")).select(words.alias("phrase"))
    return one.withColumn("status", F.when(F.col("phrase") == "pending words", "pending").otherwise("approved"))


def hits(t):
    return leads.phrase_hits(t.filings, leads.approved_phrases(phrase_table(t)))


def tally(t):
    terms = phrase_table(t).select("phrase", F.concat(F.lit("C"), F.length("phrase") % 4).alias("chokepoint"))
    return leads.proxy_tally(hits(t), terms)


def known_filers(t):
    return t.filings.select(F.col("filer").alias("ticker")).where(F.col("filer").isin("SRC0", "SRC7"))


@query("TX1 SE3", "SELECT filer, phrase, mentions FROM hits")
def phrase_sweep(t):
    return hits(t)


@query("AG16 JN7", "SELECT filer, phrase_count, mentions, phrases, round(score, 6) AS score FROM clusters")
def constraint_clusters(t):
    return leads.cluster_hits(hits(t), known_filers(t)).withColumn("phrases", F.array_join("phrases", ", "))


@query("TX1 AG16", "SELECT filer, round(score, 6) AS score FROM clusters ORDER BY clusters.score DESC, phrase_count DESC, filer LIMIT 12")
def constraint_candidates(t):
    return leads.top_candidates(leads.cluster_hits(hits(t), known_filers(t))).select("filer", "score")


@query("JN7", "SELECT DISTINCT filer FROM hits WHERE filer NOT IN ('SRC0', 'SRC7')")
def novel_filers(t):
    return hits(t).select("filer").distinct().join(known_filers(t).select(F.col("ticker").alias("filer")), "filer", "left_anti")


@query("AG17", "SELECT chokepoint, ticker, mentions FROM tally QUALIFY row_number() OVER (PARTITION BY chokepoint ORDER BY mentions DESC, ticker) <= 6")
def discovered_proxies(t):
    return leads.top_proxies(tally(t))


@query("AG18", "SELECT chokepoint, ticker, mentions, round(score, 6) AS score, generic FROM specific")
def proxy_specificity(t):
    return leads.specificity(tally(t))


@query("AG19", "SELECT ticker, count(*) AS degree, floor(avg(CAST(round(score * 1000) AS BIGINT)) + 0.5e0) / 1000 AS avg_specificity, count(*) = 1 AS pure_play, count(*) >= 3 AS hub FROM specific GROUP BY 1")
def exposure_graph(t):
    return leads.exposure(leads.specificity(tally(t)))


@query("JN9", """
WITH l AS (SELECT p_partkey AS lead, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE ['T' || (p_partkey % 50), 'T' || p_size] END AS named, CASE WHEN p_partkey % 3 = 0 THEN [] ELSE ['T' || p_size, 'T' || (p_size * 2)] END AS found FROM part),
u AS (SELECT lead, unnest(CASE WHEN len(named) + len(found) = 0 THEN [NULL] ELSE list_distinct(list_concat(named, found)) END) AS ticker FROM l),
g AS (SELECT lead, list(ticker) FILTER (ticker IS NOT NULL AND CAST(substr(ticker, 2) AS INT) >= 20) AS fresh, count(ticker) AS n FROM u GROUP BY 1)
SELECT lead, array_to_string(list_sort(coalesce(fresh, [])), ',') AS tickers FROM g WHERE n = 0 OR len(coalesce(fresh, [])) > 0""")
def novel_proxies(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    ticker = lambda x: F.concat(F.lit("T"), x.cast("string"))
    none = F.array().cast("array<string>")
    rows = t.read("part").select(
        k.alias("lead"), F.when(k % 7 == 0, none).otherwise(F.array(ticker(k % 50), ticker(s))).alias("named"),
        F.when(k % 3 == 0, none).otherwise(F.array(ticker(s), ticker(s * 2))).alias("found"))
    known = t.read("part").where(F.col("p_partkey") < 20).select(ticker(F.col("p_partkey")).alias("ticker"))
    return leads.novel_proxies(rows, known).withColumn("tickers", F.array_join("tickers", ","))


# ---- news ----------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOP)
shared(
    title_tokens=f"""SELECT news_id, title, date, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({STOP}))) AS toks FROM news""",
    watched=f"""SELECT item_id AS trigger, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({STOP}))) AS toks FROM benchmark""",
    matched="""SELECT DISTINCT q.trigger, h.news_id, h.date FROM watched q JOIN title_tokens h ON len(list_intersect(q.toks, h.toks)) >= 2
      WHERE h.date >= DATE '2001-11-05' - 120""",
)


def triggers(t):
    """Manual triggers watch for headlines like the benchmark items, a table that does not grow with the pages."""
    return t.read("benchmark").select(F.col("item_id").alias("trigger"), F.array("text").alias("queries"), F.lit("manual").alias("type"))


@query("JN8 SF3", "SELECT * FROM matched")
def matched_news(t):
    queries = leads.watchable(triggers(t)).select("trigger", F.explode("queries").alias("query"))
    return leads.match_news(t.news, queries, t.scan_date, max_age=120)


@query("TX5 JN8", "SELECT trigger, count(*) AS headlines, max(date) AS latest FROM matched GROUP BY 1")
def trigger_watch(t):
    queries = leads.watchable(triggers(t)).select("trigger", F.explode("queries").alias("query"))
    found = leads.match_news(t.news, queries, t.scan_date, max_age=120)
    return found.groupBy("trigger").agg(F.count("*").alias("headlines"), F.max("date").alias("latest"))


@query("TK2", """SELECT page_id, host FROM (SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), ''), '__nolink_' || url) AS host FROM pages)
QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 2""")
def capped_sources(t):
    return leads.cap_per_host(t.read("pages").select("page_id", F.col("url").alias("link")), "page_id").select("page_id", "host")


@query("TK3", """
WITH RECURSIVE items AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source_k, doc_id) AS i, source_k, doc_id, lower(title) AS key, title FROM (
  SELECT CAST(substr(source, 4) AS INT) AS source_k, doc_id, lang || ' ' || (n_chars % 9) AS title FROM documents)),
walk AS (SELECT 0 AS i, []::VARCHAR[] AS keys, -1 AS theme, 0 AS k, NULL::VARCHAR AS title, false AS took
 UNION ALL SELECT x.i, CASE WHEN t THEN list_append(keys, key) ELSE keys END, source_k, CASE WHEN source_k = theme THEN k ELSE 0 END + CASE WHEN t THEN 1 ELSE 0 END, x.title, t FROM (
  SELECT items.*, w.keys, w.theme, w.k, NOT list_contains(w.keys, items.key) AND (CASE WHEN items.source_k = w.theme THEN w.k ELSE 0 END) < 2 AND len(w.keys) < 24 AS t FROM walk w JOIN items ON items.i = w.i + 1) x)
SELECT 'SRC' || theme AS theme, title, doc_id AS position FROM walk JOIN items USING (i, title) WHERE took""")
def capped_headlines(t):
    rows = t.read("documents").select(
        F.expr("substr(source, 4)").cast("int").alias("theme_order"), F.upper("source").alias("theme"),
        F.col("doc_id").alias("position"), F.concat_ws(" ", "lang", (F.col("n_chars") % 9).cast("string")).alias("title"))
    return leads.cap_headlines(rows)


@query("TK4", """SELECT lang AS engine, doc_id AS position, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents
ORDER BY turn, min(doc_id) OVER (PARTITION BY lang) LIMIT 40""")
def interleaved_leads(t):
    rows = t.read("documents").select(F.col("lang").alias("engine"), F.col("doc_id").alias("position"))
    return leads.interleave(rows, 40).select("engine", "position", F.col("turn").cast("bigint").alias("turn"))


# ---- leads ---------------------------------------------------------------------------------------------

@query("TX3", f"""SELECT topic, count(*) AS papers FROM filings, (SELECT unnest([{PL}]) AS topic) WHERE contains(lower(text), topic) AND topic IN (SELECT phrase FROM hits WHERE length(phrase) <> 6) GROUP BY 1 HAVING count(*) >= 5""")
def topic_leads(t):
    proxies = hits(t).where(F.length("phrase") != 6).select(F.col("phrase").alias("topic"), F.col("filer").alias("ticker"))
    return leads.topic_leads(t.filings, phrase_table(t).where(F.col("status") == "approved").select(F.col("phrase").alias("topic")), proxies)


@query("TX2 SF1", """SELECT 'scout-' || lower(filer) || '-supply-constraint' AS theme, filer || ' supply constraint' AS scarcity, engine, CASE engine WHEN 'arxiv' THEN 'research activity around ' || filer || ' supply constraint: ' || mentions || ' papers'
 WHEN 'bom-ladder' THEN filer || ' supply constraint is upstream of N1' ELSE 'filers report stress around ' || filer || ' supply constraint (' || replace(phrases, ', ', '; ') || ')' END AS thesis, '2027' AS bind_window, 'low' AS priced_in
FROM (SELECT *, CASE phrase_count % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'bom-ladder' ELSE 'constraint-shadow' END AS engine FROM clusters)""")
def draft_themes(t):
    k = F.col("phrase_count") % 3
    rows = leads.cluster_hits(hits(t), known_filers(t)).select(
        F.when(k == 0, "arxiv").when(k == 1, "bom-ladder").otherwise("constraint-shadow").alias("engine"),
        F.concat("filer", F.lit(" supply constraint")).alias("subject"), F.col("filer").alias("ticker"), F.col("filer").alias("company"),
        "phrases", F.when(k == 1, "N1").alias("ladder_from"), F.when(k == 0, F.col("mentions")).alias("papers"))
    return leads.draft_candidates(rows).select("theme", "scarcity", "engine", "thesis", "bind_window", "priced_in")


# ---- page text -----------------------------------------------------------------------------------------

def clean_sql(c: str) -> str:
    for p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>"):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    for a, b in T.ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


shared(page_text=f"SELECT page_id, {clean_sql('html')} AS txt FROM pages")


@query("SF2", "SELECT page_id, length(txt) AS chars, md5(txt) AS digest, trim(substr(txt, 1, 600)) AS excerpt FROM page_text")
def page_excerpts(t):
    full = T.html_text(F.col("html"))
    return t.read("pages").withColumn("_t", full).select(
        "page_id", F.length("_t").cast("bigint").alias("chars"), F.md5(F.col("_t").cast("binary")).alias("digest"),
        T.strip(F.substring("_t", 1, 600)).alias("excerpt"))


def passages_sql(src: str, key: str, text: str, words: list[str], limit: int) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
WITH s AS (SELECT {key}, {text} AS txt, w, string_split(lower({text}), w) AS parts FROM {src}, (SELECT unnest([{listed}]) AS w)),
p AS (SELECT {key}, txt, w, unnest(list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda q: length(q))) AS BIGINT) + (i - 1) * length(w))) AS pos FROM s WHERE len(parts) > 1),
sp AS (SELECT {key}, txt, greatest(0, pos - 240) AS a, least(length(txt), pos + length(w) + 240) AS b FROM p),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY {key} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT {key}, CAST(k AS BIGINT) AS k, trim(regexp_replace(substr(any_value(txt), min(a) + 1, max(b) - min(a)), '\\s+', ' ', 'g')) AS passage FROM g WHERE k <= {limit} GROUP BY {key}, k"""


@query("TX4 WN29 SF2", passages_sql("page_text", "page_id", "txt", ["tion", "menu", "copyright"], 4))
def page_passages(t):
    rows = t.read("pages").select("page_id", T.html_text(F.col("html")).alias("_t"))
    found = rows.select("page_id", F.posexplode(T.passages(F.col("_t"), ["tion", "menu", "copyright"], limit=4)).alias("k", "passage"))
    return found.select("page_id", (F.col("k") + 1).cast("bigint").alias("k"), "passage")


@query("WN29", passages_sql("documents", "doc_id", "text", ["worthless", "orantion", "thanedble", "pathetic"], 4))
def filing_passages(t):
    words = ["worthless", "orantion", "thanedble", "pathetic"]
    any_word = F.lower("text").rlike("|".join(words))
    found = t.filings.where(any_word).select("doc_id", F.posexplode(T.passages(F.col("text"), words)).alias("k", "passage"))
    return found.select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), "passage")


# ---- scalar functions ----------------------------------------------------------------------------------

@query("SF1", """SELECT p_partkey, 'scout-' || regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 substr(trim(regexp_replace(regexp_replace(s, '[^0-9A-Za-z_ .,()/+-]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 120) AS name,
 CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type ELSE p_name END AS term
FROM (SELECT *, p_name || CASE p_partkey % 3 WHEN 0 THEN ' of the (' || p_brand || ') 0.' || p_size || 'mm grades' WHEN 1 THEN ' ' || p_type || ' with for' ELSE ' <b>!' || p_size || ' and "x"</b>' END AS s FROM part)""")
def search_terms(t):
    k = F.col("p_partkey") % 3
    tail = (F.when(k == 0, F.concat(F.lit(" of the ("), "p_brand", F.lit(") 0."), F.col("p_size").cast("string"), F.lit("mm grades")))
            .when(k == 1, F.concat(F.lit(" "), "p_type", F.lit(" with for")))
            .otherwise(F.concat(F.lit(" <b>!"), F.col("p_size").cast("string"), F.lit(' and "x"</b>'))))
    s = F.concat("p_name", tail)
    return t.read("part").select("p_partkey", T.slug(s).alias("slug"), T.clean_name(s).alias("name"), T.search_term(s).alias("term"))


@query("SF3", f"""SELECT conv_id, turn, len(toks) AS words, array_to_string(list_sort(toks), ' ') AS tokens FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({STOP}))) AS toks FROM conversations)""")
def significant_words(t):
    rows = t.read("conversations").select("conv_id", "turn", T.significant_tokens(F.col("text")).alias("_t"))
    return rows.select("conv_id", "turn", F.size("_t").cast("bigint").alias("words"), F.array_join(F.array_sort("_t"), " ").alias("tokens"))


@query("SF4", """SELECT p_partkey, unnest(list_distinct([p_name || ' ' || p_type || ' x', a || ' shortage supply deficit', a || ' demand growth forecast', a || ' capacity capex expansion investment', a || ' export controls policy tariff', a || ' bottleneck lead time backlog'])) AS q
FROM (SELECT *, p_name || ' ' || p_type AS a FROM part)""")
def thesis_queries(t):
    subject = F.concat_ws(" ", "p_name", "p_type", F.lit(" x "))
    return t.read("part").select("p_partkey", F.explode(T.thesis_queries(subject)).alias("q"))


@query("SF5", """SELECT p_partkey, sha256(lower(array_to_string(list_concat([p_name], list_sort(['Z' || p_size, 'A' || p_brand]), list_sort([p_type, 'Be' || p_size])), '|'))) AS fingerprint FROM part""")
def lead_fingerprints(t):
    size = F.col("p_size").cast("string")
    return t.read("part").select("p_partkey", T.evidence_hash(
        F.col("p_name"), F.array(F.concat(F.lit("Z"), size), F.concat(F.lit("A"), "p_brand")),
        F.array(F.col("p_type"), F.concat(F.lit("Be"), size))).alias("fingerprint"))


@query("SF12", """SELECT DISTINCT conv_id, turn, phrase FROM (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(regexp_replace(line, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''), '^[\"''`]|[\"''`]$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS phrase FROM (
 SELECT conv_id, turn, unnest(string_split(trim(text), chr(10))) AS line FROM conversations)) WHERE length(phrase) BETWEEN 4 AND 80""")
def reply_phrases(t):
    return t.read("conversations").select("conv_id", "turn", F.explode(T.phrase_lines(F.col("text"))).alias("phrase"))


@query("SF12", """SELECT p_partkey, p_name AS input, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' is scarce' ELSE '' END AS why, CASE WHEN p_partkey % 3 = 0 THEN 'AB,CDE' ELSE '' END AS tickers FROM part UNION ALL SELECT p_partkey, 'second input', 'because', '' FROM part""")
def ladder_replies(t):
    line = F.concat(
        F.lit("1. "), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" — "), "p_type", F.lit(" is scarce"))).otherwise(""),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(" — proxies: AB, cde, TOOLONG")).otherwise(""), F.lit("\n- second input: because\nx"))
    rows = t.read("part").select("p_partkey", F.explode(T.ladder_lines(line)).alias("l"))
    return rows.select("p_partkey", "l.input", "l.why", F.array_join("l.tickers", ",").alias("tickers"))
