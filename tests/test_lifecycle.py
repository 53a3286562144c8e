"""Streams with timers, expiry and initial state; the phrase automaton, the news join, passages and the remainder."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.operators import leads, ledger, sizing, technicals
from tidegauge.sources import files, store
from tidegauge.streaming import jobs, lifecycle

D = dt.date


def test_claims_settle_or_expire(spark, tmp_path):
    day = lambda i: D(2001, 1, 1) + dt.timedelta(days=i)
    claims = spark.createDataFrame(
        [(1, "A", "up", day(0), day(5), 10.0), (2, "A", "down", day(0), day(5), 10.0), (3, "A", "up", day(30), day(40), 10.0),
         (4, "B", "up", day(1), day(6), 10.0), (5, "A", "up", day(80), day(90), 10.0)],
        "id bigint, subject string, claim string, date date, resolve_on date, price_at double")
    bars = spark.createDataFrame([("A", day(0), 10.0), ("A", day(7), 12.0), ("A", day(45), 9.0), ("B", day(40), 99.0), ("~", day(88), None)],
                                 "ticker string, d date, close double")
    stream = lifecycle.settled_dates(lifecycle.replay(claims, str(tmp_path / "c"), "date"), lifecycle.replay(bars, str(tmp_path / "b"), "d"), grace=20)
    out = lifecycle.collected(stream, str(tmp_path / "o"), str(tmp_path / "k"))
    got = {r["id"]: (r["status"], r["correct"]) for r in lifecycle.graded(claims, out).collect()}
    # B's next close comes after its 20 days of grace
    assert got == {1: ("resolved", True), 2: ("resolved", False), 3: ("resolved", False), 4: ("expired", None), 5: ("open", None)}


def test_seen_keys_are_flagged_and_renewed(spark, tmp_path):
    days = [0, 10, 95, 200, 291, 382]  # each sighting renews the key for 90 days
    rows = [("s", f"i{n}", "k", D(2001, 1, 1) + dt.timedelta(days=n)) for n in days] + [("s", "j", "other", D(2001, 1, 11))]
    items = spark.createDataFrame(rows, "subject string, item string, key string, d date")
    out = lifecycle.collected(lifecycle.flag_seen(lifecycle.replay(items, str(tmp_path / "i"), "d")), str(tmp_path / "o"), str(tmp_path / "k"), idle=False)
    assert {r["item"]: r["is_new"] for r in out.collect()} == {"i0": True, "i10": False, "i95": False, "i200": True, "i291": True, "i382": True, "j": True}


def test_replay_deals_a_slice_to_many_files(spark, tmp_path, monkeypatch):
    """A slice is written and read by several tasks, each micro-batch holds one slice, and few rows leave files empty."""
    monkeypatch.setattr(lifecycle, "ROWS_PER_FILE", 10)
    rows = [(i, D(2001, 1, 1) + dt.timedelta(days=i // 3)) for i in range(150)] + [(999, D(2001, 3, 31))]  # 1 row in the last slice
    stream = lifecycle.replay(spark.createDataFrame(rows, "n int, d date"), str(tmp_path / "in"), "d")
    seen = {}
    run = stream.writeStream.foreachBatch(lambda batch, k: seen.update({k: batch.select("d", F.spark_partition_id().alias("p")).collect()})) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    spans = [(min(r["d"] for r in got), max(r["d"] for r in got), len(got)) for _, got in sorted(seen.items())]
    assert spans == [(D(2001, 1, 1), D(2001, 1, 30), 90), (D(2001, 1, 31), D(2001, 2, 19), 60), (D(2001, 3, 31), D(2001, 3, 31), 1)]
    assert len(list((tmp_path / "in").glob("slice=0/*.parquet"))) == len(list((tmp_path / "in").glob("slice=2/*.parquet"))) == 10


def test_streams_keep_state_by_groups(spark, tmp_path, monkeypatch):
    """More subjects than groups: the state store is asked once a group and batch, and each subject has its own outcome."""
    day = lambda i: D(2001, 1, 1) + dt.timedelta(days=i)
    subjects = [f"S{i}" for i in range(40)]
    bars = spark.createDataFrame([(s, day(i + d), 10.0 + i) for i, s in enumerate(subjects) for d in (0, 8)] + [("~", day(90), None)], "ticker string, d date, close double")
    claims = spark.createDataFrame([(i, s, "up", day(i), day(i + 5), 10.0) for i, s in enumerate(subjects)] + [(99, "~", "up", day(90), day(95), 10.0)],
                                   "id bigint, subject string, claim string, date date, resolve_on date, price_at double")
    monkeypatch.setattr(lifecycle, "group", lambda key: jobs.group(key, 3))
    stream = lifecycle.settled_dates(lifecycle.replay(claims, str(tmp_path / "c"), "date"), lifecycle.replay(bars, str(tmp_path / "b"), "d"), grace=20)
    out = lifecycle.collected(stream, str(tmp_path / "o"), str(tmp_path / "k")).collect()
    assert {(r["subject"], r["priced_on"], r["price"]) for r in out} == {(s, day(i + 8), 10.0 + i) for i, s in enumerate(subjects)} and len(out) == 40
    scans = spark.createDataFrame([(s, day(d), (i + d) % 3 > 0) for i, s in enumerate(subjects) for d in range(9)], "trigger string, d date, met boolean")
    got = lifecycle.collected(jobs.trigger_stream(lifecycle.replay(scans, str(tmp_path / "s"), "d"), groups=3), str(tmp_path / "so"), str(tmp_path / "sk")).collect()
    met = lambda i, d: d >= 0 and (i + d) % 3 > 0
    fired = lambda i, d: met(i, d) and met(i, d - 1)
    assert {(r["trigger"], r["d"]): (r["met"], r["fired"], r["pending"], r["newly_fired"]) for r in got} == {
        (s, day(d)): (met(i, d), fired(i, d), met(i, d) and not met(i, d - 1), fired(i, d) and not fired(i, d - 1)) for i, s in enumerate(subjects) for d in range(9)}


def test_candidate_memory_survives_a_restart(spark, tmp_path):
    schema = "n bigint, id string, status string, evidence_hash string"
    memory = spark.createDataFrame([("a", "rejected", "1"), ("b", "accepted", "1")], "id string, status string, evidence_hash string")
    lifecycle_enabled(spark)
    parts = [[(1, "a", None, "1"), (2, "b", None, "2"), (3, "c", None, "1"), (4, "a", None, "2")], [(5, "c", "rejected", "1"), (6, "a", "accepted", "2")],
             [(7, "c", None, "1"), (8, "c", None, "9"), (9, "a", None, "3"), (10, "d", None, "1")]]
    for part in parts:  # the stream stops after each and goes on from its checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lifecycle.recall_candidates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), memory, groups=3)
        out = lifecycle.collected(stream, str(tmp_path / "o"), str(tmp_path / "k"))
    assert {r["n"]: r["fresh"] for r in out.collect()} == {1: False, 2: False, 3: True, 4: True, 7: False, 8: True, 9: False, 10: True}


def lifecycle_enabled(spark):
    from tidegauge.streaming.jobs import enable_state

    enable_state(spark)


def test_phrases_equal_plain_search(spark):
    rnd = random.Random(4)
    words = ["on", "allocation", "lead", "times", "ALLOC", "é", "supply", "x"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) + rnd.choice(["", "\n", "  "]) for _ in range(60)] + [None, "", "x" * 9000]
    phrases = {" ".join(rnd.choices([w.lower() for w in words], k=rnd.randint(1, 3))) for _ in range(300)} | {"", " ", "ocat", "x x", "never seen"}
    df = spark.createDataFrame([(f"f{i % 3}", t) for i, t in enumerate(texts)], "filer string, text string")
    listed = spark.createDataFrame([(p,) for p in phrases] + [("on",), (None,)], "phrase string")
    want = {}
    for i, t in enumerate(texts):
        for p in phrases:
            if t is not None and p in t.lower():
                want[f"f{i % 3}", p] = want.get((f"f{i % 3}", p), 0) + 1
    for chars in (leads.BLOCK, 200):
        found = leads.holding(df, "text", listed, chars).groupBy("filer", "phrase").count()
        assert {(r[0], r[1]): r[2] for r in found.collect()} == want
    assert leads.holding(df, "text", listed.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [2, 3])
def test_news_join_equals_plain_pairs(spark, shared):
    rnd = random.Random(shared)
    words = [f"word{i}" for i in range(25)] + ["common"] * 10
    title = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 7)))
    day = D(2001, 11, 1)
    news = [(i, title() or None, None if i % 9 == 0 else day - dt.timedelta(days=i)) for i in range(80)]
    asked = [(i % 10, title()) for i in range(30)]
    got = leads.match_news(spark.createDataFrame(news, "news_id int, title string, date date"), spark.createDataFrame(asked, "trigger int, query string"),
                           F.lit(day), max_age=45, shared=shared)
    want = {(t, n, d) for t, q in asked for n, x, d in news if (d is None or (day - d).days <= 45) and len(set(q.split()) & set((x or "").split())) >= shared}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_passages_of_many_hits(spark):
    dense = spark.createDataFrame([("xx tion " * 200_000,)], "text string")
    assert [len(p) for p in dense.select(T.passages(F.col("text"), ["tion", "xx"])).first()[0]] == [1_599_999]
    far = "tion" + " " * 600
    spread = spark.createDataFrame([(far * 3 + "menu tion" + " " * 600 + far * 5,)], "text string")
    assert spread.select(T.passages(F.col("text"), ["tion", "menu", "none"])).first()[0] == ["tion", "tion", "tion", "menu tion"]


def test_rsi_blocks_do_not_matter(spark):
    rnd = random.Random(9)
    rows = [(t, D(2000, 1, 1) + dt.timedelta(days=i), 100 + rnd.random() * 10 + (i if t == "UP" else 0)) for t in ("A", "UP") for i in range(120)]
    rows += [("UP2", D(2000, 1, 1) + dt.timedelta(days=i), 10.0 + i) for i in range(40)] + [("NAN", D(2000, 1, 1) + dt.timedelta(days=i), float("nan")) for i in range(40)]
    bars = spark.createDataFrame(rows, "ticker string, d date, close double")
    whole = {(r[0], r[1]): r[2] for r in technicals.rsi_series(bars, 10).collect()}
    cut = {(r[0], r[1]): r[2] for r in technicals.rsi_series(bars, 10, block=7).collect()}
    assert len(whole) == len(rows) and whole.keys() == cut.keys()
    assert all((a is None) == (cut[k] is None) and (a is None or abs(a - cut[k]) < 1e-9) for k, a in whole.items())
    assert whole["UP2", D(2000, 2, 5)] == 100.0 and all(v is None for (t, _), v in whole.items() if t == "NAN")


def test_remainder_of_equal_fractions(spark):
    rows = [(g, f"T{i:04d}", (0.5 if g == "same" else (i % 7) / 7.0) + i % 3) for g in ("same", "mixed") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t string, x double").withColumn("total", F.lit(600).cast("bigint"))
    got = {}
    for ranked in (100_000, 10):
        got[ranked] = {(r["g"], r["t"]): r["whole"] for r in sizing.largest_remainder(df, ["g"], "x", "total", "t", ranked).collect()}
    assert got[10] == got[100_000] and all(sum(v for (g, _), v in got[10].items() if g == name) == 600 for name in ("same", "mixed"))


def test_look_ahead_is_the_first_close(spark):
    bars = spark.createDataFrame([("A", D(2001, 1, i), float(i)) for i in (2, 5, 9)], "ticker string, d date, close double")
    wanted = spark.createDataFrame([("A", D(2001, 1, i)) for i in range(1, 12)] + [("B", D(2001, 1, 1))], "ticker string, on date")
    got = {(r["ticker"], r["on"].day): r["price"] for r in ledger.price_on_or_after(wanted, bars).collect()}
    assert [got["A", i] for i in range(1, 12)] == [2, 2, 5, 5, 5, 9, 9, 9, 9, None, None] and got["B", 1] is None


def test_facts_of_mixed_payloads(spark):
    value = '{"start":"2001-01-01","end":"2001-12-31","val":%s,"fp":"FY","form":"10-K"}'
    body = '{"cik":1,"facts":{"us-gaap":{"Revenues":{"units":{"USD":[' + value % 5 + "," + value % '"n/a"' + ']}},"Odd":7,"Cash":{"units":{"USD":[' + value % "2.5" + "]}}}}}"
    rows = spark.createDataFrame([("A", body), ("B", "not json"), ("C", None), ("D", '{"facts":[]}')], "ticker string, body string")
    every = {(r["ticker"], r["concept"], r["val"]) for r in files.parse_company_facts(rows, "body", "ticker").collect()}
    assert every == {("A", "Revenues", 5.0), ("A", "Cash", 2.5)}
    assert [r["concept"] for r in files.parse_company_facts(rows, "body", "ticker", concepts=["Cash", "None"]).collect()] == ["Cash"]


def test_point_read_skips_row_groups(spark, tmp_path):
    """An absent ticker inside the stored range: the filter leaves no row group to read."""
    rows = spark.range(200_000).select(F.concat(F.lit("T"), F.col("id") * 2).alias("ticker"), F.lit("2001-01-02").cast("date").alias("d"),
                                       F.lit(1.0).alias("close"), F.lit("yahoo").alias("source"))
    store.upsert(spark, str(tmp_path / "s"), rows.coalesce(1))
    assert store.read_series(spark, str(tmp_path / "s"), ["T100001"]).count() == 0
    df = store.read_series(spark, str(tmp_path / "s"), ["T100001"])
    df.collect()
    scanned = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scanned and "In(ticker" in scanned or "EqualTo(ticker" in scanned
    assert store.read_series(spark, str(tmp_path / "s"), ["T100000"]).count() == 1
