"""Sizing, ledger, votes and validation on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import options
from tidegauge.operators import diversify, history, ledger, signals, sizing, validate, votes

HOLDING = ("portfolio_id bigint, ticker string, account string, axis string, role string, target_usd bigint, "
           "vol double, tilt string, opportunity double")


def holdings(spark, n=40, seed=1, portfolios=2):
    rnd = random.Random(seed)
    rows = []
    for p in range(portfolios):
        for i in range(n):
            rows.append((p, f"T{i:02d}", rnd.choice(["ira", "taxable"]), rnd.choice([None, "diversifier", "deep-tech"]),
                         rnd.choice(["core", "De-correlator sleeve"]), rnd.randint(1, 99999),
                         rnd.choice([None, rnd.uniform(0.05, 0.9)]), rnd.choice(["overweight", "underweight", "neutral"]),
                         rnd.choice([None, rnd.uniform(0, 100)])))
    return spark.createDataFrame(rows, HOLDING)


@pytest.mark.parametrize("mode", ["research", "signal"])
def test_every_cell_conserves_its_dollars(spark, mode):
    out = sizing.target_weights(holdings(spark), mode, F.lit("risk-on"))
    cells = out.groupBy(*sizing.CELL).agg(F.sum("base_usd").alias("a"), F.sum("target_usd").alias("b"),
                                          F.max("factor").alias("hi"), F.min("factor").alias("lo")).collect()
    assert len(cells) == 8 and all(r["a"] == r["b"] for r in cells)
    for r in cells:
        top = 1.15 * 1.3 * 1.15 if mode == "signal" and r["axis"] != "diversifier" else 1.15
        assert r["hi"] <= top + 1e-9


def largest(exact, total):
    floors = [int(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (-(exact[i] - floors[i]), i))
    for i in order[:total - sum(floors)]:
        floors[i] += 1
    return floors


def test_largest_remainder_with_ties(spark):
    rnd = random.Random(9)
    for exact in ([1 / 3] * 3 + [0.0], [2.5] * 10, [rnd.random() * 50 for _ in range(300)]):
        total = round(sum(exact))
        rows = [(1, f"T{i:04d}", float(x), total) for i, x in enumerate(exact)]
        df = spark.createDataFrame(rows, "g int, t string, x double, total bigint")
        got = [r["whole"] for r in sizing.largest_remainder(df, ["g"], "x", "total", "t").orderBy("t").collect()]
        assert got == largest(exact, total) and sum(got) == total


def test_taxable_trims_are_blocked_and_funding_is_separate(spark):
    rows = [(1, "taxable", "deep-tech", "A", 100, 60, 0.5, False), (1, "taxable", "deep-tech", "B", 100, 140, 0.5, False),
            (1, "ira", "deep-tech", "C", 100, 50, 0.5, False), (1, "ira", "deep-tech", "D", 100, 150, 0.5, False)]
    df = spark.createDataFrame(rows, "portfolio_id bigint, account string, axis string, ticker string, base_usd bigint, "
                                     "target_usd bigint, weight_in_cell double, trim_ok boolean").withColumn("current_usd", F.lit(None).cast("double"))
    plan = sizing.rebalance_rows(df)
    acted = {r["ticker"]: r["actioned_usd"] for r in plan.collect()}
    assert acted == {"A": 0, "B": 40, "C": -50, "D": 50}
    cash = spark.createDataFrame([(1, "taxable", 15)], "portfolio_id bigint, account string, cash_usd bigint")
    s = sizing.rebalance_summary(plan, cash).first()
    assert (s["buy_usd"], s["sell_usd"], s["blocked_trim_usd"], s["needs_new_cash_usd"]) == (90, 50, 40, 25)


def test_exactly_35_percent_is_a_breach(spark):
    df = spark.createDataFrame([(1, "A", 100.0, None)], "portfolio_id bigint, ticker string, usd double, beta double")
    out = {r["scenario"]: r for r in sizing.stress(df, [{"id": "x", "market": -0.35, "beta": 1.0, "targeted": {}},
                                                        {"id": "y", "market": 0.0, "beta": 1.0, "targeted": {"A": -0.1}}]).collect()}
    assert out["x"]["breaches_35"] and out["y"]["drawdown"] == pytest.approx(-0.1)


def test_schedule_conserves_the_target(spark):
    df = spark.createDataFrame([(1, t, 1001 + i) for i, t in enumerate(["A", "B", "C", "D", "DRY"])], "portfolio_id bigint, tier string, target_usd bigint")
    got = {r["tier"]: (r["s"], r["n"]) for r in sizing.dca_schedule(df).groupBy("tier").agg(F.sum("amount").alias("s"), F.count("*").alias("n")).collect()}
    assert got["A"] == (1001, 1) and got["D"] == (1004, 1) and got["DRY"] == (0, 1)
    assert got["B"][1] == 4 and abs(got["B"][0] - 1002) <= 1 and got["C"][1] == 10 and abs(got["C"][0] - 1003) <= 1


def test_funding_is_idempotent_and_sums_to_one(spark):
    rows = [(1, "A", 0.6, False, 600, 1000), (1, "B", 0.35, False, 350, 1000), (1, "W", 0.05, True, 50, 1000)]
    book = spark.createDataFrame(rows, "portfolio_id bigint, ticker string, weight double, is_diversifier boolean, target_usd bigint, sleeve_usd bigint")
    names = spark.createDataFrame([(1, "X", 0.9, 0.2), (1, "Y", None, None), (1, "A", 0.9, 0.2)],
                                  "portfolio_id bigint, ticker string, conviction double, vol double")
    fund = diversify.fund_sleeve(names, book, 0.15)
    assert {r["ticker"] for r in fund.collect()} == {"X", "Y"}
    after = diversify.apply_funding(book, fund)
    assert after.agg(F.sum("weight")).first()[0] == pytest.approx(1.0, abs=1e-3)
    flags = after.withColumn("is_diversifier", F.col("ticker").isin("W", "X", "Y")).withColumn("sleeve_usd", F.lit(1000).cast("bigint"))
    again = diversify.apply_funding(flags, fund)
    assert sorted(map(tuple, again.select("ticker", "weight").collect())) == sorted(map(tuple, after.select("ticker", "weight").collect()))


def test_scale_does_not_depend_on_the_order_of_holdings(spark):
    """The scale, 0.65 / 0.832 = 0.78125, lies on a half and goes up: noise in the sums would scale a name of weight
    0.0048 to 0.0037 in one book and 0.0038 in another."""
    rnd, rows = random.Random(3), []
    for p in range(60):
        own = [(f"W{i}", w, True) for i, w in enumerate([0.0022, 0.0123, 0.0166, 0.0183, 0.0195, 0.0201, 0.0309, 0.0481])]
        rnd.shuffle(own)
        rows += [(p, t, w, d, int(w * 1_000_000), 1_000_000) for t, w, d in [*own, ("A", 0.0048, False), ("B", 0.8272, False)]]
    book = spark.createDataFrame(rows, "portfolio_id bigint, ticker string, weight double, is_diversifier boolean, target_usd bigint, sleeve_usd bigint")
    names = spark.createDataFrame([(p, f"N{c}", c, 1.0) for p in range(60) for c in (0.602, 0.612, 0.606)],
                                  "portfolio_id bigint, ticker string, conviction double, vol double")
    fund = diversify.fund_sleeve(names, book, 0.35)
    assert {r["weight"] for r in fund.collect()} == {0.0602, 0.0612, 0.0606}
    after = diversify.apply_funding(book, fund).where(F.col("ticker") == "A")
    assert {(r["weight"], r["target_usd"]) for r in after.collect()} == {(0.0038, 3800)}


def test_trim_keeps_axis_totals(spark):
    rows = [(1, "ira", "A", 0.5, "deep-tech", "core", 500, 1000), (1, "ira", "B", 0.3, "deep-tech", "core", 300, 1000),
            (1, "ira", "W", 0.2, "diversifier", "core", 200, 1000)]
    df = spark.createDataFrame(rows, "portfolio_id bigint, account string, ticker string, weight double, axis string, role string, target_usd bigint, sleeve_usd bigint")
    edit = lambda t, e: spark.createDataFrame([(t, e)], "ticker string, edit string")
    trimmed = {r["ticker"]: r["weight"] for r in sizing.cut_or_trim(df, edit("A", "trim")).collect()}
    assert trimmed["A"] + trimmed["B"] == pytest.approx(0.8, abs=1e-3) and trimmed["W"] == pytest.approx(0.2)
    emptied = {r["ticker"]: r["weight"] for r in sizing.cut_or_trim(df, edit("W", "cut")).collect()}
    assert set(emptied) == {"A", "B"} and sum(emptied.values()) == pytest.approx(1.0, abs=1e-3)
    assert sizing.cut_or_trim(df, edit("Z", "cut")).count() == 3


def test_option_parity_and_round_trip(spark):
    df = spark.createDataFrame([(100.0, 105.0, 0.5, 0.3), (50.0, 55.0, 0.75, 0.35)], "s double, k double, t double, v double")
    c = lambda kind: options.price(F.lit(kind), F.col("s"), F.col("k"), F.col("t"), F.col("v"))
    rows = df.withColumn("c", c("call")).withColumn("p", c("put")).withColumn(
        "iv", options.implied_vol(F.lit("call"), F.col("s"), F.col("k"), F.col("t"), F.col("c"))).withColumn(
        "none", options.implied_vol(F.lit("call"), F.col("s"), F.col("k"), F.col("t"), F.lit(500.0)))
    import math

    for r in rows.collect():
        assert r["c"] - r["p"] == pytest.approx(r["s"] - r["k"] * math.exp(-0.04 * r["t"]), abs=1e-4)
        assert r["iv"] == pytest.approx(r["v"], abs=1e-3) and r["none"] is None


def test_price_on_or_after(spark):
    rnd = random.Random(2)
    day = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=i)
    bars = [(t, day(i), float(i)) for t in "AB" for i in sorted(rnd.sample(range(100), 30))]
    asks = [(i, rnd.choice("ABC"), day(rnd.randint(0, 110))) for i in range(200)]
    got = ledger.price_on_or_after(spark.createDataFrame(asks, "id int, ticker string, on date"),
                                   spark.createDataFrame(bars, "ticker string, d date, close double")).collect()
    want = {i: min(((d, c) for t2, d, c in bars if t2 == t and d >= on), default=(None, None))[1] for i, t, on in asks}
    assert {r["id"]: r["price"] for r in got} == want


def test_kill_deadlines(spark):
    rows = [("2027",), ("2027-02",), ("2027-03-05",), ("someday",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ledger.deadline(F.col("t"))).collect()]
    assert got == [dt.date(2027, 12, 31), dt.date(2027, 2, 28), dt.date(2027, 3, 5), None, None]


def test_prune_boundary(spark):
    today = dt.date(2002, 1, 1)
    rows = [(i, "Z", "up", today - dt.timedelta(days=300), today - dt.timedelta(days=over), 1.0) for i, over in enumerate((30, 180, 181))]
    claims = spark.createDataFrame(rows, "id int, subject string, claim string, date date, resolve_on date, price_at double")
    bars = spark.createDataFrame([], "ticker string, d date, close double")
    got = {r["id"]: r["status"] for r in ledger.resolve_tilts(claims, bars, F.lit(today)).collect()}
    assert got == {0: "open", 1: "open", 2: "expired"}


def test_two_run_confirmation_and_fabricated_citations(spark):
    v = spark.createDataFrame([("a", True, 0.8), ("a", True, 0.7), ("b", True, 0.9), ("b", True, 0.9), ("c", True, 0.9), ("c", False, 0.1)],
                              "trigger string, met boolean, confidence double")
    ev = spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("c", 3, 3)], "trigger string, filings int, news int")
    prev = spark.createDataFrame([("a", "likely-met")], "trigger string, status string")
    got = {r["trigger"]: r["status"] for r in votes.catalyst_consensus(v, ev, prev).collect()}
    assert got == {"a": "fired", "b": "approaching", "c": "approaching"}


@pytest.mark.parametrize("values, level, value", [
    (["low"] * 3, "tight", "low"), (["low", "low", "high"], "moderate", "low"), (["low", "high"], "wide", None)])
def test_dispersion(spark, values, level, value):
    df = spark.createDataFrame([("x", v) for v in values], "item string, value string")
    r = votes.consensus(df).first()
    assert (r["level"], r["value"]) == (level, value)


def test_review_can_only_lower(spark):
    cols = ("theme string, priced_in string, bind_window string, non_consensus boolean, new_priced_in string, new_bind_window string, "
            "new_non_consensus boolean, confidence double, penalty double, hard_fail boolean, answered boolean, review string, review_adj double")
    rows = [("a", "low", "now", True, "high", None, None, 0.6, 0.0, False, True, "revise", 0.4),
            ("b", "low", "now", True, "high", None, None, 0.6, 0.0, False, True, "revise", -0.4),
            ("c", "low", "now", True, "low", None, None, 0.9, 0.0, False, True, "approve", None),
            ("d", "low", "now", True, "high", None, None, 0.9, 0.0, True, True, "approve", None),
            ("e", "low", "now", True, "high", None, None, 0.9, 0.0, False, True, "veto", None)]
    got = {r["theme"]: (r["outcome"], r["confidence"]) for r in votes.decide(spark.createDataFrame(rows, cols)).collect()}
    assert got["a"] == ("proposal", 0.6) and got["b"] == ("below-confidence", 0.2) and got["c"][0] == "no-change"
    assert got["d"][0] == "verification-failed" and got["e"][0] == "vetoed"


def test_phrases_keep_their_status(spark):
    old = spark.createDataFrame([("On Allocation", "rejected", None)], "phrase string, status string, added date")
    new = spark.createDataFrame([("on allocation",), ("take or pay",)], "phrase string")
    got = {r["phrase"]: r["status"] for r in votes.merge_phrases(old, new, F.current_date()).collect()}
    assert got == {"On Allocation": "rejected", "take or pay": "pending"}


def test_seen_state_expires(spark):
    today = F.lit(dt.date(2001, 6, 1))
    seen = spark.createDataFrame([("a", dt.date(2001, 5, 1)), ("b", dt.date(2001, 1, 1))], "key string, d date")
    items = spark.createDataFrame([("a", None), ("b", None), ("c", None)], "key string, d date")
    assert {r["key"]: r["is_new"] for r in history.mark_new(items, seen, today).collect()} == {"a": False, "b": True, "c": True}
    assert {r["key"] for r in history.advance_seen(items.where("key = 'c'"), seen, today).collect()} == {"a", "c"}


def test_rejected_candidates_return_with_new_evidence(spark):
    memory = spark.createDataFrame([("a", "rejected", "1"), ("b", "rejected", "1"), ("c", "accepted", "1")], "id string, status string, evidence_hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "1")], "id string, evidence_hash string")
    assert {r["id"]: r["fresh"] for r in history.split_candidates(now, memory).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_validation_lists_every_error(spark):
    df = spark.createDataFrame([(1, "", "cash", None, "", "", "odd")],
                               "portfolio_id bigint, ticker string, account string, target_usd double, tier string, role string, axis string")
    assert validate.holdings(df).count() == 6


def test_valuation_label_softens_for_growth(spark):
    rows = [(60.0, 20.0, 0.5), (60.0, 20.0, 0.0), (10.0, None, None), (None, 20.0, 0.5)]
    df = spark.createDataFrame(rows, "pe double, peer double, yoy double")
    got = [r[0] for r in df.select(signals.valuation_tag(F.col("pe"), F.col("peer"), F.col("yoy"))).collect()]
    assert got == ["fair", "rich", "cheap", None]


def test_skewed_portfolio_keeps_every_row(spark):
    rows = [(1 if i % 3 else 2, f"T{i:05d}", "ira", "deep-tech", "core", 7, 0.2, "neutral", None) for i in range(6000)]
    out = sizing.target_weights(spark.createDataFrame(rows, HOLDING), "research")
    assert out.count() == 6000 and out.agg(F.sum("target_usd")).first()[0] == 42000


def test_cash_counts_in_the_sleeve_of_a_priced_book(spark):
    rows = [("a", "X", 2.0, 10.0, 20.0), ("b", "X", 1.0, None, None), ("c", "X", 1.0, 5.0, 5.0)]
    valued = spark.createDataFrame(rows, "portfolio_id string, ticker string, shares double, price double, usd double")
    cash = spark.createDataFrame([("a", 4.6), ("b", 9.0)], "portfolio_id string, cash_usd double")
    got = {r["portfolio_id"]: r["sleeve_usd"] for r in signals.sleeve_value(valued, cash).collect()}
    assert got == {"a": 25, "b": None, "c": 5}


def test_after_tax_places_follow_the_multiples(spark):
    rows = spark.createDataFrame([("p", "X", "ira", "core", "deep-tech")], "portfolio_id string, ticker string, account string, role string, sleeve string")
    got = signals.after_tax_multiples(rows).orderBy("place").collect()
    assert [r["place"] for r in got] == [1, 2, 3] and {r["location"] for r in got} == {"roth", "traditional", "taxable"}
    assert [r["multiple"] for r in got] == sorted((r["multiple"] for r in got), reverse=True)


def test_claims_stay_open_resolve_or_expire(spark):
    day = lambda *x: dt.date(*x)
    claims = spark.createDataFrame([("new", "up", day(2001, 6, 2)), ("due", "up", day(2001, 5, 30)), ("good", "up", day(2001, 5, 30)),
                                    ("old", "up", day(2000, 1, 1))], "id string, claim string, resolve_on date")
    graded = spark.createDataFrame([("new", True), ("good", False)], "id string, correct boolean")
    got = {r["id"]: (r["status"], r["correct"]) for r in ledger.claim_states(claims, graded, F.lit("2001-06-01").cast("date")).collect()}
    assert got == {"new": ("open", None), "due": ("open", None), "good": ("resolved", False), "old": ("expired", None)}


def test_position_value_is_rate_times_price_times_shares(spark):
    rate = 1.1
    cells = [(p / 100, float(s)) for p in range(201, 260) for s in range(1, 50)]
    pos = spark.createDataFrame([(f"S{i}", s) for i, (_, s) in enumerate(cells)], "ticker string, shares double")
    quotes = spark.createDataFrame([(f"S{i}", p) for i, (p, _) in enumerate(cells)], "ticker string, price double")
    names = pos.select("ticker", F.lit("EUR").alias("currency"), F.lit(True).alias("is_foreign"))
    rates = spark.createDataFrame([("EUR", rate)], "currency string, rate double")
    got = {r["ticker"]: r["usd"] for r in signals.position_usd(pos, quotes, names, rates).collect()}
    assert got == {f"S{i}": rate * p * s for i, (p, s) in enumerate(cells)}


def test_buckets_follow_the_rows():
    from tidegauge.plans.tables import bucket_count

    assert bucket_count(6_000) == 8 and bucket_count(36_000_000) == 180 and bucket_count(216_000_000) == 1080


def test_modes_side_by_side_equal_single_modes_without_a_shuffle(spark, tmp_path):
    rows = [(p, f"S{i}", ("taxable", "ira")[i % 2], ("diversifier", "deep-tech")[i % 3 == 0], "core", 1000 + 37 * i * (p + 1), "A",
             0.1 + i % 5 / 10 if i % 4 else None, "overweight", float(i * 7 % 100)) for p in range(6) for i in range(20)]
    kind = ("portfolio_id bigint, ticker string, account string, axis string, role string, target_usd bigint, tier string, "
            "vol double, tilt string, opportunity double")
    df = spark.createDataFrame(rows, kind)
    (df.write.mode("overwrite").format("parquet").option("path", str(tmp_path / "held")).bucketBy(4, "portfolio_id")
     .sortBy("portfolio_id").saveAsTable("held_by_portfolio"))
    both = sizing.targets_by_mode(spark.table("held_by_portfolio"), ["signal", "research"], F.lit("risk-on"))
    keys = ["portfolio_id", "account", "axis", "ticker"]
    for mode in ("signal", "research"):
        one = sizing.target_weights(df, mode, F.lit("risk-on")).select(*keys, "target_usd")
        assert sorted(map(tuple, both.select(*keys, f"{mode}_usd").collect())) == sorted(map(tuple, one.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sizing.targets_by_mode(spark.table("held_by_portfolio"), ["signal"], F.lit("risk-on"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP TABLE held_by_portfolio")
    assert "Exchange" not in plan
