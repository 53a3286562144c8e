"""Series operators against hand-made cases and step-by-step Python."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import align, cross_section, evaluate, metrics, quality, reconcile, regression, technicals, timing

DAY0 = dt.date(2000, 1, 3)


def bars(spark, closes, ticker="A", start=DAY0, step=1):
    rows = [(ticker, start + dt.timedelta(days=i * step), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, d date, close double")


def walk(n, seed, start=100.0, vol=0.02):
    rnd = random.Random(seed)
    out = [start]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rnd.gauss(0.0003, vol)))
    return out


def wilder(closes, p):
    x = [b - a for a, b in zip(closes, closes[1:])]
    g = sum(max(v, 0) for v in x[:p]) / p
    l = sum(max(-v, 0) for v in x[:p]) / p
    for v in x[p:]:
        g, l = (g * (p - 1) + max(v, 0)) / p, (l * (p - 1) + max(-v, 0)) / p
    return 100.0 if l == 0 else 100 - 100 / (1 + g / l)


def test_rsi_matches_recurrence(spark):
    series = {"UP": [float(i) for i in range(1, 40)], "DOWN": [float(i) for i in range(60, 10, -1)],
              "RND": walk(300, 1), "SHORT": [1.0, 2.0, 3.0]}
    frame = None
    for name, closes in series.items():
        part = bars(spark, closes, name)
        frame = part if frame is None else frame.unionByName(part)
    got = {r["ticker"]: r["rsi_14"] for r in technicals.rsi(frame, 14).collect()}
    assert got["UP"] == 100.0 and got["DOWN"] == pytest.approx(0.0) and got["SHORT"] is None
    assert got["RND"] == pytest.approx(wilder(series["RND"], 14))
    last = {r["ticker"]: r["rsi"] for r in technicals.rsi_series(frame, 14).groupBy("ticker").agg(F.max_by("rsi", "d").alias("rsi")).collect()}
    assert last["RND"] == pytest.approx(got["RND"]) and last["UP"] == 100.0 and last["SHORT"] is None


def test_windows_are_full_or_null(spark):
    s = technicals.series(bars(spark, walk(260, 2))).orderBy("d").collect()
    assert s[198]["ma200"] is None and s[199]["ma200"] is not None
    assert s[251]["mom_12m"] is None and s[252]["mom_12m"] is not None
    assert s[251]["vol_1y"] is None and s[252]["vol_1y"] is not None


def test_high_is_trailing_year_only(spark):
    closes = [1000.0] + walk(400, 3)
    snap = technicals.snapshot(bars(spark, closes)).first()
    assert snap["high52"] == pytest.approx(max(closes[-252:]))
    assert snap["vol_3m"] == pytest.approx(
        statistics.stdev([math.log(b / a) for a, b in zip(closes[-64:], closes[-63:])]) * math.sqrt(252))


def test_snapshot_equals_last_row_of_series(spark):
    b = bars(spark, walk(500, 4))
    a, z = technicals.snapshot(b).first().asDict(), technicals.series(b).orderBy(F.desc("d")).first().asDict()
    for k, v in a.items():
        if k in z and isinstance(v, float):
            assert v == pytest.approx(z[k]), k


def test_today_is_appended_replaced_or_refused(spark):
    b = bars(spark, walk(80, 5))
    last = DAY0 + dt.timedelta(days=79)
    for day, n in ((last + dt.timedelta(days=1), 81), (last, 80), (last - dt.timedelta(days=1), 0)):
        today = spark.createDataFrame([("A", day, 55.0)], "ticker string, d date, price double")
        out = technicals.append_today(b, today).collect()
        assert len(out) == n
        if n:
            assert max(out, key=lambda r: r["d"])["close"] == 55.0
    short = technicals.append_today(bars(spark, walk(30, 5)), today)
    assert short.count() == 0


@pytest.mark.parametrize("prices, status, close", [
    ([100, 100.5, 99.8], "consensus", 100), ([100, 140], "conflict", None), ([100, 100.4, 150], "consensus", 100.2),
    ([100], "single", 100)])
def test_provider_agreement(spark, prices, status, close):
    rows = [(f"p{i}", "A", dt.date(2001, 3, 5), float(p)) for i, p in enumerate(prices)]
    got = reconcile.by_day(spark.createDataFrame(rows, "provider string, ticker string, d date, close double")).first()
    assert got["status"] == status
    assert got["close"] == (None if close is None else pytest.approx(close))


def despike(rows, jump=0.5):
    out = []
    for i, (ok, c) in enumerate(rows):
        nxt = rows[i + 1][1] if i + 1 < len(rows) else None
        if not ok and out and abs(c / out[-1][1] - 1) > jump and nxt and abs(nxt / out[-1][1] - 1) <= jump:
            continue
        out.append((i, c))
    return [i for i, _ in out]


def test_spikes_match_sequential_rule(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for k in range(60):
        seq = [(rnd.random() < 0.3, rnd.choice([10.0, 11.0, 17.0, 30.0, 4.0])) for _ in range(25)]
        want[f"T{k}"] = despike(seq)
        rows += [(f"T{k}", DAY0 + dt.timedelta(days=i), "consensus" if ok else "single", c) for i, (ok, c) in enumerate(seq)]
    frame = spark.createDataFrame(rows, "ticker string, d date, status string, close double")
    kept = reconcile.flag_spikes(frame).where("not spike").collect()
    got = {}
    for r in kept:
        got.setdefault(r["ticker"], []).append((r["d"] - DAY0).days)
    assert {t: sorted(v) for t, v in got.items()} == want


def test_corroboration_never_invents_a_price(spark):
    rows = [("A", "yahoo", 100.0, 1), ("A", "stooq", 150.0, 2), ("B", "stooq", 10.0, 2), ("C", "yahoo", 10.0, 1), ("C", "stooq", 10.1, 2)]
    got = {r["ticker"]: r for r in quality.corroborate(
        spark.createDataFrame(rows, "ticker string, source string, price double, source_rank int")).collect()}
    assert got["A"]["used"] == 100.0 and got["A"]["ok"] is False
    assert got["B"]["ok"] is None and got["C"]["ok"] is True and got["C"]["used"] == pytest.approx(10.05)


def test_daily_check(spark):
    both = bars(spark, range(1, 30), "DAILY").unionByName(bars(spark, range(1, 30), "MONTHLY", step=30))
    got = {r["ticker"]: r["is_daily"] for r in quality.daily_frequency(both).collect()}
    assert got == {"DAILY": True, "MONTHLY": False}


def test_metrics_of_known_series(spark):
    rows = bars(spark, [100, 120, 90, 150, 75]).withColumnRenamed("close", "value")
    m = metrics.series_metrics(rows, ["ticker"]).first()
    assert m["max_drawdown"] == pytest.approx(0.5) and m["breaches_35"] and m["n"] == 5
    up = metrics.series_metrics(bars(spark, [1, 2, 3, 4]).withColumnRenamed("close", "value"), ["ticker"]).first()
    assert up["max_drawdown"] == 0 and up["sortino"] is None and up["calmar"] is None


def crash_path():
    out = [100.0]
    for i in range(240):
        out.append(out[-1] * 1.002)
    for i in range(50):
        out.append(out[-1] * (0.95 if i % 2 else 1.0))
    for i in range(120):
        out.append(out[-1] * 1.003)
    return out


def sequential_rule(closes, n=200, cost=0.001):
    hold, timed, prev, switches = [], [], None, 0
    h = b = 100.0
    for i in range(n, len(closes)):
        pos = 1 if closes[i - 1] > sum(closes[i - n:i]) / n else 0
        ret = closes[i] / closes[i - 1]
        h, b = h * ret, b * (ret if pos else 1)
        if prev is not None and pos != prev:
            b, switches = b * (1 - cost), switches + 1
        prev = pos
        hold.append(h), timed.append(b)
    return hold, timed, switches


def test_rule_path_matches_loop_and_cuts_the_crash(spark):
    closes = crash_path()
    hold, timed, switches = sequential_rule(closes)
    rows = evaluate.moving_average_path(bars(spark, closes), min_bars=260).orderBy("d").collect()
    assert [r["hold"] for r in rows] == pytest.approx(hold) and [r["timed"] for r in rows] == pytest.approx(timed)
    proof = evaluate.rule_proof(evaluate.moving_average_path(bars(spark, closes), min_bars=260)).first()
    assert proof["switches"] == switches and proof["reduces_tail"]


def test_no_look_ahead(spark):
    closes = crash_path()
    changed = closes[:-1] + [closes[-1] * 3]
    for path in (lambda b: evaluate.moving_average_path(b, min_bars=260), evaluate.ladder_path):
        a = [r["pos"] for r in path(bars(spark, closes)).orderBy("d").collect()]
        b = [r["pos"] for r in path(bars(spark, changed)).orderBy("d").collect()]
        assert a == b and len(a) > 100


def episodes(v, depth):
    out, peak, ip, trough, it, is_open = [], v[0], 0, v[0], 0, False
    for i in range(1, len(v)):
        if v[i] >= peak:
            if is_open and (peak - trough) / peak >= depth:
                out.append((ip, it))
            peak, ip, trough, it, is_open = v[i], i, v[i], i, False
        else:
            is_open = True
            if v[i] < trough:
                trough, it = v[i], i
    if is_open and (peak - trough) / peak >= depth:
        out.append((ip, it))
    return out


def test_episodes_match_sequential_scan(spark):
    rows, want = None, {}
    for k in range(15):
        v = walk(200, 100 + k, vol=0.05)
        want[f"T{k}"] = episodes(v, 0.2)
        part = bars(spark, v, f"T{k}").withColumnRenamed("close", "v")
        rows = part if rows is None else rows.unionByName(part)
    got = {k: [] for k in want}
    for r in evaluate.drawdown_episodes(rows, ["ticker"], "v", ["v"]).collect():
        got[r["ticker"]].append(((r["from_d"] - DAY0).days, (r["to_d"] - DAY0).days))
        assert r["v_dd"] == pytest.approx(r["depth"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_episodes_are_judged_at_the_precision_shown(spark):
    """0.495 is not below 0.5 - 0.005, whatever the digits that are not shown; 0.494999 is."""
    rows = [("A", 0, 100.0, 100.0), ("A", 1, 49.99996, 50.50003), ("B", 0, 100.0, 100.0), ("B", 1, 50.0, 50.5001)]
    path = spark.createDataFrame(rows, "ticker string, i int, hold double, timed double").withColumn(
        "d", F.date_add(F.lit(DAY0), F.col("i")))
    got = {r["ticker"]: (r["depth"], r["timed_dd"], r["timed_helped"])
           for r in evaluate.drawdown_episodes(path, ["ticker"], "hold", ["timed"]).collect()}
    assert got == {"A": (0.5, 0.495, False), "B": (0.5, 0.494999, True)}


def test_every_other_column_is_judged_as_shown(spark):
    """The blend's 0.978086 is not below 0.983086 - 0.005, the timed column's drawdown is."""
    rows = [("A", 0, 100.0, 100.0, 100.0), ("A", 1, 1.69141, 15.8787, 2.191449)]
    path = spark.createDataFrame(rows, "ticker string, i int, hold double, timed double, mixed double").withColumn(
        "d", F.date_add(F.lit(DAY0), F.col("i")))
    got = evaluate.drawdown_episodes(path, ["ticker"], "hold", ["timed", "mixed"]).first()
    assert (got["depth"], got["timed_dd"], got["mixed_dd"]) == (0.983086, 0.841213, 0.978086)
    assert got["timed_helped"] is True and got["mixed_helped"] is False


def test_mixed_drawdown_lies_between(spark):
    proof = evaluate.rule_proof(evaluate.ladder_path(bars(spark, crash_path())), blend=0.4).first()
    lo, hi = sorted([proof["hold_max_drawdown"], proof["timed_max_drawdown"]])
    assert lo <= proof["mixed_max_drawdown"] <= hi


def test_suppression_beats_sql_and(spark):
    term = spark.createDataFrame([("A", False), ("B", None)], "ticker string, term_inverted boolean")
    credit = spark.createDataFrame([("A", None), ("B", True)], "ticker string, credit_stressed boolean")
    got = {r["ticker"]: (r["stress"], r["missing"]) for r in timing.composite_stress(term, credit).collect()}
    assert got == {"A": (None, "credit"), "B": (None, "term")}


def test_velocity_rank_equals_sorted_threshold(spark):
    for seed in range(4):
        c = walk(300, 40 + seed)
        vel = [math.log(c[i - 20] / c[i]) for i in range(20, len(c))]
        want = vel[-1] >= sorted(vel[-252:])[239] and vel[-1] > 0
        assert timing.spread_velocity(bars(spark, c)).first()["credit_stressed"] == want
    flat = timing.spread_velocity(bars(spark, [10.0] * 300)).first()
    assert flat["credit_stressed"] is False
    assert timing.spread_velocity(bars(spark, [10.0] * 100)).first()["credit_stressed"] is None


def test_alignment_and_index(spark):
    a = bars(spark, [10, 11, 12, 13], "A")
    b = bars(spark, [20, 22, 21], "B", DAY0 + dt.timedelta(days=1))
    one = bars(spark, [5], "LONE")
    series = a.unionByName(b).unionByName(one).withColumn("grp", F.lit("g"))
    rows = align.align(series).select("ticker", "d").collect()
    assert sorted({r["d"] for r in rows}) == [DAY0 + dt.timedelta(days=i) for i in (1, 2, 3)]
    idx = align.basket_index(a.unionByName(b).withColumn("grp", F.lit("g"))).orderBy("d").collect()
    assert [r["value"] for r in idx] == pytest.approx([100, 100 * (12 / 11 + 22 / 20) / 2, 100 * (13 / 11 + 21 / 20) / 2])


def planted(spark, betas, n=400, noise=0.001):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        x = [rnd.gauss(0, 0.01) for _ in betas]
        y = 0.0005 + sum(b * v for b, v in zip(betas, x)) + rnd.gauss(0, noise)
        rows.append(("g", DAY0 + dt.timedelta(days=i), y, *x))
    names = [f"x{i}" for i in range(len(betas))]
    return spark.createDataFrame(rows, "grp string, d date, y double, " + ", ".join(f"{c} double" for c in names)), names, rows


@pytest.mark.parametrize("betas", [[0.7], [0.7, -0.4], [0.7, -0.4, 1.3]])
def test_ols_matches_least_squares(spark, betas):
    import numpy as np

    df, names, rows = planted(spark, betas)
    fit = regression.ols(df, ["grp"], "y", names).first()
    m = np.array([[1.0, *r[3:]] for r in rows])
    y = np.array([r[2] for r in rows])
    coef, *_ = np.linalg.lstsq(m, y, rcond=None)
    res = y - m @ coef
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * (res @ res) / (len(y) - len(coef)))
    for i in range(len(coef)):
        assert fit[f"coef_{i}"] == pytest.approx(coef[i], rel=1e-8)
        assert fit[f"t_{i}"] == pytest.approx(coef[i] / se[i], rel=1e-6)


def test_ols_singular_is_left_out(spark):
    df, _, _ = planted(spark, [0.5])
    assert regression.ols(df.withColumn("x1", F.col("x0") * 2), ["grp"], "y", ["x0", "x1"]).count() == 0


def test_residual_loading_is_one_sided(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        m, f = rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)
        d = DAY0 + dt.timedelta(days=i)
        rows += [("m", d, m), ("c", d, 1.1 * m + f), ("hedge", d, 0.5 * m - 0.8 * f + rnd.gauss(0, 1e-3)),
                 ("amplify", d, 0.5 * m + 0.8 * f + rnd.gauss(0, 1e-3))]
    df = spark.createDataFrame(rows, "grp string, d date, ret double")
    pick = lambda g: df.where(F.col("grp") == g).select("d", "ret")
    got = {r["grp"]: r for r in regression.residual_loading(
        df.where(F.col("grp").isin("hedge", "amplify")), pick("m"), pick("c")).collect()}
    assert got["hedge"]["qualifies"] and not got["amplify"]["qualifies"]
    assert got["amplify"]["residual_beta"] == pytest.approx(0.8, abs=0.02)


@pytest.mark.parametrize("drift, sign", [(True, 1), (False, -1)])
def test_rank_ic_sign(spark, drift, sign):
    rows = []
    for i in range(400):
        d = DAY0 + dt.timedelta(days=i)
        rows.append(("C", d, 100.0))
        for g in range(6):
            slope = (g - 2.5) * 0.001
            level = math.exp(slope * i) if drift else math.exp(0.1 * abs((i + g * 20) % 84 / 42 - 1))
            rows.append((f"G{g}", d, 100 * level))
    df = spark.createDataFrame(rows, "ticker string, d date, close double")
    members = df.where("ticker <> 'C'").select(F.col("ticker").alias("grp"), "ticker").distinct()
    ic = cross_section.rank_ic(cross_section.relative_pairs(df, members, df.where("ticker = 'C'").select("ticker").distinct())).first()
    assert ic["ic"] * sign > 0.2


def test_average_ranks_match_sorted_ranks(spark):
    from tidegauge.functions.scalar import average_rank

    rnd = random.Random(5)
    v = [round(rnd.gauss(0, 1), 1) for _ in range(500)] + [1e9, -1e9, 0.0]
    want = {x: (sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2) for x in v}
    got = average_rank(spark.createDataFrame([(x,) for x in v], "x double"), "x", "r").collect()
    assert len(got) == len(v) and all(r["r"] == want[r["x"]] for r in got)


def test_term_inversion_is_decided_by_the_first_low_or_unusable_session(spark):
    cases = {"up": [(2.0, 1.0), (2.0, 1.0), (2.0, 1.0)], "low_first": [(2.0, None), (2.0, 1.0), (0.5, 1.0)],
             "gap_first": [(0.5, 1.0), (2.0, 0.0), (2.0, 1.0)], "gap_only": [(2.0, 1.0), (None, 1.0), (2.0, 1.0)],
             "short": [(0.5, 1.0), (0.5, 1.0)]}
    rows = [(k, i, a, b) for k, pairs in cases.items() for i, (a, b) in enumerate(pairs)]
    got = timing.term_inversion(spark.createDataFrame(rows, "ticker string, d int, near double, far double"))
    assert {r["ticker"]: r["term_inverted"] for r in got.collect()} == {
        "up": True, "low_first": False, "gap_first": None, "gap_only": None, "short": None}


def test_shallowest_member_in_natural_order(spark):
    members = spark.createDataFrame([("g", "N12", 5), ("g", "N2", 5), ("g", "N1", 9)], "grp string, ticker string, bars bigint")
    common = spark.createDataFrame([("g", 5)], "grp string, bars bigint")
    assert quality.truncation(members, common).first()["shallow_ticker"] == "N2"
