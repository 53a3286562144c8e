"""Text functions, leads, file sources and the store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.operators import leads
from tidegauge.sources import files, store


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [
    ("grain-oriented electrical steel (GOES) 0.23-0.35mm domain-refined grades", "grain-oriented electrical steel"),
    ("bushings and", "bushings"), ("2nd stage", ""), ("a b c d e f", "a b c d"), (None, "")])
def test_search_term(spark, raw, want):
    assert one(spark, raw, T.search_term) == want


def test_html_text(spark):
    html = "<p>A&amp;B</p><script>x<y</script><style>p{}</style>\n <b>C</b>&nbsp;D"
    assert one(spark, html, T.html_text) == "A&B C D"


def spans(text, words, window=240, limit=4):
    low, found = text.lower(), []
    for w in words:
        i = low.find(w)
        while i >= 0:
            found.append([max(0, i - window), min(len(text), i + len(w) + window)])
            i = low.find(w, i + len(w))
    merged = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [" ".join(text[a:b].split()) for a, b in merged[:limit]]


def test_passages_match_scan(spark):
    rnd = random.Random(4)
    words = ["lead time", "ab", "ba", "c.d"]
    texts = ["".join(rnd.choice(["ab", "ba", " x", "y ", "lead time", "c.d", "cxd", "z" * 300]) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", T.passages(F.col("t"), words).alias("p")).collect()}
    assert got == {i: spans(t, words) for i, t in enumerate(texts)}


def test_phrase_and_ladder_parsing(spark):
    text = "1. Lead Times Extended\n- \"on allocation\"\n• on allocation\nabc\n" + "x" * 90
    assert one(spark, text, T.phrase_lines) == ["lead times extended", "on allocation"]
    assert one(spark, '["Sole Source Supply", "abc"]', T.phrase_lines) == ["sole source supply"]
    rows = one(spark, "- transformer bushings — few makers — proxies: ABB, hubb\nglass: slow to qualify\nab", T.ladder_lines)
    assert [(r["input"], r["why"], r["tickers"]) for r in rows] == [
        ("transformer bushings", "few makers", ["ABB", "HUBB"]), ("glass", "slow to qualify", [])]
    reply = '[{"input": "clean rooms", "why": "slow", "tickers": ["abc", "TOOLONG"]}, {"input": "x"}, {"why": "no input"}]'
    assert [(r["input"], r["why"], r["tickers"]) for r in one(spark, reply, T.ladder_lines)] == [("clean rooms", "slow", ["ABC"])]


def test_votes_and_verdicts_keep_every_key(spark):
    from tidegauge.operators import votes

    cast = spark.createDataFrame([("a", "low"), ("a", "low"), ("b", None), ("c", "odd")], "item string, value string")
    assert sorted(tuple(r) for r in votes.consensus(cast).collect()) == [
        ("a", 2, "low", 1.0, "tight"), ("b", 0, None, 0.0, "wide"), ("c", 0, None, 0.0, "wide")]
    verdicts = spark.createDataFrame([("t", None, 0.9)], "trigger string, met boolean, confidence double")
    evidence = spark.createDataFrame([("u", 3, 3)], "trigger string, filings bigint, news bigint")
    got = votes.catalyst_consensus(verdicts, evidence, spark.createDataFrame([("v", "likely-met")], "trigger string, status string"))
    assert sorted(tuple(r) for r in got.collect()) == [(k, "monitoring", False, 0.0, 0, 0, False) for k in "tuv"]


def test_index_is_null_with_a_broken_close(spark):
    from tidegauge.operators import technicals

    rows = [(t, f"2001-01-{i + 1:02d}", float("nan") if t == "N" and i == 3 else None if t == "M" and i == 3 else 100.0 + i * (-1) ** i)
            for t in "NMG" for i in range(30)]
    bars = spark.createDataFrame(rows, "ticker string, d string, close double").withColumn("d", F.col("d").cast("date"))
    assert {r["ticker"]: r["rsi_14"] is None for r in technicals.rsi(bars, 14).collect()} == {"N": True, "M": True, "G": False}
    assert {r["ticker"] for r in technicals.rsi_series(bars, 14).where("rsi is not null").collect()} == {"G"}


def test_clustering_prefers_breadth(spark):
    hits = [("AAA", "p1", 1), ("AAA", "p2", 1), ("AAA", "p3", 1), ("BBB", "p1", 900), ("CCC", "p1", 50), ("CCC", "p2", 50), ("NVDA", "p1", 5), ("NVDA", "p2", 5)]
    df = spark.createDataFrame(hits, "filer string, phrase string, mentions bigint")
    known = spark.createDataFrame([("NVDA",)], "ticker string")
    got = [r["filer"] for r in leads.top_candidates(leads.cluster_hits(df, known)).collect()]
    assert got == ["AAA", "CCC"]


def test_generic_names_rank_last(spark):
    rows = [("c1", "BIG", 9), ("c2", "BIG", 9), ("c3", "BIG", 9), ("c1", "PURE", 4)]
    out = leads.specificity(spark.createDataFrame(rows, "chokepoint string, ticker string, mentions bigint"))
    got = {(r["chokepoint"], r["ticker"]): (r["score"], r["generic"]) for r in out.collect()}
    assert got[("c1", "PURE")][0] > got[("c1", "BIG")][0] and got[("c1", "BIG")][1] and not got[("c1", "PURE")][1]
    assert {r["ticker"]: (r["hub"], r["pure_play"]) for r in leads.exposure(out).collect()} == {"BIG": (True, False), "PURE": (False, True)}


def greedy(items, per_theme=2, total=24):
    seen, out, count = set(), [], {}
    for theme, pos, title in sorted(items):
        if title in seen or count.get(theme, 0) >= per_theme or len(out) >= total:
            continue
        seen.add(title), out.append((theme, pos))
        count[theme] = count.get(theme, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_headline_caps_match_greedy(spark, seed):
    rnd = random.Random(seed)
    titles = [f"t{i}" for i in range(rnd.choice([5, 20, 60]))]
    items = [(t, p, rnd.choice(titles)) for t in range(rnd.choice([10, 60])) for p in range(5)]
    df = spark.createDataFrame([(t, f"N{t}", p, x) for t, p, x in items], "theme_order int, theme string, position bigint, title string")
    for per, total in ((2, 24), (2, 6)):
        got = [(int(r["theme"][1:]), r["position"]) for r in leads.cap_headlines(df, per, total).collect()]
        assert sorted(got) == greedy(items, per, total)


def test_news_needs_two_words(spark):
    rnd = random.Random(8)
    words = ["copper", "supply", "deficit", "smelter", "outage", "alpha", "beta", "gamma"]
    news = [(i, " ".join(rnd.sample(words, 3)), dt.date(2001, 1, 1)) for i in range(80)]
    queries = [(i % 3, " ".join(rnd.sample(words, rnd.choice([1, 2, 4])))) for i in range(9)]
    got = {(r["trigger"], r["news_id"]) for r in leads.match_news(
        spark.createDataFrame(news, "news_id int, title string, date date"),
        spark.createDataFrame(queries, "trigger int, query string"), F.lit(dt.date(2001, 1, 10))).collect()}
    want = {(t, i) for t, q in queries for i, title, _ in news
            if len({w for w in q.split() if len(w) > 3} & {w for w in title.split() if len(w) > 3}) >= 2}
    assert got == want


def test_interleave_is_fair(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "engine string, position int")
    assert [r["position"] for r in leads.interleave(df, 4).collect()] == [1, 4, 5, 2]


def test_file_readers(spark, tmp_path):
    (tmp_path / "csv").mkdir(), (tmp_path / "json").mkdir(), (tmp_path / "xml").mkdir()
    (tmp_path / "csv" / "abc.csv").write_text("Date,Open,High,Low,Close,Volume\n2001-01-02,1,1,1,10.5,3\nN/D,1,1,1,1,1\n2001-01-03,1,1,1,-4,1\nshort\n")
    (tmp_path / "json" / "abc.json").write_text('{"date": "2001-01-02T00:00", "close": 4, "adjClose": 2}\n{"date": "2001-01-03", "close": 5}\n')
    (tmp_path / "xml" / "a.xml").write_text(
        "<rss><channel><item><title>A &amp;amp; B</title><link>http://x</link><pubDate>Tue, 02 Jan 2001 10:00:00 GMT</pubDate></item>"
        "<item><title></title><link>y</link></item></channel></rss>")
    assert [tuple(r) for r in files.read_history_csv(spark, str(tmp_path / "csv")).collect()] == [("ABC", dt.date(2001, 1, 2), 10.5)]
    assert sorted(tuple(r) for r in files.read_history_json(spark, str(tmp_path / "json")).collect()) == [
        ("ABC", dt.date(2001, 1, 2), 2.0), ("ABC", dt.date(2001, 1, 3), 5.0)]
    assert [tuple(r) for r in files.read_rss(spark, str(tmp_path / "xml")).collect()] == [("A & B", "http://x", dt.date(2001, 1, 2))]
    (tmp_path / "xml" / "a.xml").write_text("<feed><entry><title> A <b>B</b></title><summary>s  t</summary><published>2001</published></entry></feed>")
    assert files.read_atom(spark, str(tmp_path / "xml")).count() == 1


def test_store_upsert_is_idempotent_and_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("A", dt.date(2000, 1, 3), 1.0, "yahoo"), ("A", dt.date(2001, 1, 3), 2.0, "yahoo"), ("A", dt.date(2001, 1, 6), 9.0, "yahoo"),
            ("B", dt.date(2001, 1, 3), 3.0, "scraped")]
    df = spark.createDataFrame(rows, "ticker string, d date, close double, source string")
    store.upsert(spark, path, df)
    newer = spark.createDataFrame([("A", dt.date(2001, 1, 3), 5.0, "consensus")], df.schema)
    for _ in range(2):
        store.upsert(spark, path, newer)
    got = sorted(tuple(r) for r in store.read_series(spark, path).collect())
    assert got == [("A", dt.date(2000, 1, 3), 1.0), ("A", dt.date(2001, 1, 3), 5.0)]
    plan = store.read_series(spark, path, ["A"], "2001-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(d" in plan and "year" in plan.split("PartitionFilters")[1][:80]


def test_phrases_are_swept_in_blocks(spark):
    from tidegauge.operators import leads

    phrases = spark.createDataFrame([(f"phrase {i:04d}", "approved") for i in range(1200)] + [("nothing", "pending")], "phrase string, status string")
    filings = spark.createDataFrame([("A", "a Phrase 0007 and phrase 1100"), ("A", "phrase 0007 nothing"), ("B", None)], "filer string, text string")
    got = {(r["filer"], r["phrase"]): r["mentions"] for r in leads.phrase_hits(filings, leads.approved_phrases(phrases)).collect()}
    assert got == {("A", "phrase 0007"): 2, ("A", "phrase 1100"): 1}
    seed = leads.approved_phrases(phrases.where("status = 'pending'"))
    assert seed.count() == len(leads.SEED_PHRASES)
