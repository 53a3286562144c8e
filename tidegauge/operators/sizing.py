"""Target weights, rebalancing, stress and schedules for many portfolios at once.

A frame of holdings has one row per (portfolio_id, account, ticker). Sums over a portfolio or a
cell are aggregates joined back, never windows over the whole portfolio, so a portfolio with a large
share of the rows is split like any other skewed join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import clamp, fixed, half_up, ratio, with_cells, with_group
from tidegauge.operators.universe import sleeve_axis
from tidegauge.session import cut

CELL = ["portfolio_id", "account", "axis"]
FRACTION_BUCKETS = 1024

# Stress scenarios (market move, beta of the book, per-name overrides).
SCENARIOS = [
    {"id": "digestion", "market": -0.35, "beta": 1.2, "targeted": {}},
    {"id": "rate-shock", "market": -0.25, "beta": 1.3, "targeted": {}},
    {"id": "recession", "market": -0.30, "beta": 1.1, "targeted": {}},
    {"id": "china-re-peace", "market": 0.0, "beta": 1.0, "targeted": {"MP": -0.5, "LYC": -0.5}},
]


def risk_factors(holdings: DataFrame, cap: float = 0.15) -> DataFrame:
    """Add `risk_factor`: geometric-mean volatility of the portfolio over the name's, within 1 +- cap.
    A name without volatility, or a portfolio with fewer than two, stays at 1."""
    vol = F.when((F.col("vol") > 0) & ~F.isnan("vol"), F.col("vol"))
    grouped = with_group(holdings, ["portfolio_id"], _center=F.exp(F.avg(F.ln(vol))), _valid=F.count(vol))
    factor = F.when(F.col("_valid") >= 2, clamp(F.col("_center") / vol, 1 - cap, 1 + cap))
    return grouped.withColumn("risk_factor", F.coalesce(factor, F.lit(1.0))).drop("_center", "_valid")


def opportunity_factor(score: Column, cap: float = 0.30) -> Column:
    return F.coalesce(clamp(1 - cap + 2 * cap * (score / 100), 1 - cap, 1 + cap), F.lit(1.0))


def regime_factor(tilt: Column, posture: Column, cap: float = 0.15) -> Column:
    return (F.when((tilt == "overweight") & (posture == "risk-on"), 1 + cap)
            .when(tilt == "underweight", 1 - cap).otherwise(1.0))


def largest_remainder(rows: DataFrame, keys: list[str], exact: str, total: str, tie: str, ranked: int = 100_000,
                      sizes: DataFrame | None = None) -> DataFrame:
    """Whole amounts that sum to the group's total exactly: floor, then one more for the rows with the
    largest fractions (ties by `tie`). Groups of at most `ranked` rows are ordered where they lie, larger ones are
    dealt. `sizes` is a frame to count the groups from, if one is at hand that costs less than `rows`.
    """
    counted = (rows if sizes is None else sizes).groupBy(*keys).agg(F.count("*").alias("_n"))
    large = counted.where(F.col("_n") > ranked).select(*keys)
    if large.isEmpty():
        return _ordered(rows, keys, exact, total, tie)
    large = cut(large)
    few = _ordered(rows.join(large, keys, "left_anti"), keys, exact, total, tie)
    return few.unionByName(_dealt(rows.join(large, keys, "left_semi"), keys, exact, total, tie, ranked))


def _ordered(rows: DataFrame, keys: list[str], exact: str, total: str, tie: str) -> DataFrame:
    """One window over each group: its floors' sum, and the place of each fraction."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_frac"), tie)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    floors = rows.withColumn("_floor", F.floor(exact).cast("bigint")).withColumn("_frac", F.col(exact) - F.col("_floor"))
    placed = floors.withColumns({"_k": F.row_number().over(order), "_quota": F.max(total).over(whole) - F.sum("_floor").over(whole)})
    more = F.coalesce((F.col("_k") <= F.col("_quota")).cast("bigint"), F.lit(0))
    return placed.withColumn("whole", F.col("_floor") + more).drop("_floor", "_frac", "_k", "_quota")


def _dealt(rows: DataFrame, keys: list[str], exact: str, total: str, tie: str, ranked: int) -> DataFrame:
    """No group is ranked in one task. Fractions fall into buckets, and the buckets' counts tell which are paid in
    full, which not at all, and which single one per group is cut. A cut bucket of at most `ranked` rows is
    ordered; a larger one is cut again by a finer digit of the fraction, and where fractions are equal by
    the letters of `tie`, one after another.
    """
    fraction = F.col("_frac")
    floors = rows.withColumn("_floor", F.floor(exact).cast("bigint")).withColumn("_frac", F.col(exact) - F.col("_floor"))
    floors = cut(floors.withColumn("_id", F.monotonically_increasing_id()))
    sums = floors.groupBy(*keys).agg(F.sum("_floor").alias("_s"), F.max(total).alias("_total"))
    quota = F.greatest(F.col("_total") - F.col("_s"), F.lit(0)).alias("_quota")
    todo = cut(floors.join(sums, keys).select(*keys, tie, "_frac", "_id", quota))
    paid, digits = [], _digits(fraction, F.col(tie))
    while True:
        counted = todo.groupBy(*keys).agg(F.count("*").alias("_n"))
        if counted.where(F.col("_n") > ranked).isEmpty():
            break
        digit, descending = next(digits, (None, None))
        if digit is None:  # equal in fraction and tie: whichever
            break
        large = todo.join(counted.where(F.col("_n") > ranked).select(*keys), keys, "left_semi").withColumn("_digit", digit)
        per = large.groupBy(*keys, "_digit").agg(F.count("*").alias("_n"), F.max("_quota").alias("_whole"))
        order = Window.partitionBy(*keys).orderBy(F.desc("_digit") if descending else F.asc("_digit"))
        before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        per = per.select(*keys, "_digit", "_n", F.greatest(F.col("_whole") - before, F.lit(0)).alias("_left"))
        split = cut(large.drop("_quota").join(per, [*keys, "_digit"]))
        paid.append(split.where(F.col("_left") >= F.col("_n")).select("_id"))
        cut_one = split.where((F.col("_left") > 0) & (F.col("_left") < F.col("_n"))).select(*keys, tie, "_frac", "_id", F.col("_left").alias("_quota"))
        small = todo.join(counted.where(F.col("_n") <= ranked).select(*keys), keys, "left_semi")
        todo = cut(small.unionByName(cut_one))
    order = Window.partitionBy(*keys).orderBy(F.desc("_frac"), tie, "_id")
    chosen = todo.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_quota")).select("_id")
    for part in paid:
        chosen = chosen.unionByName(part)
    more = F.coalesce(F.col("_more"), F.lit(0))
    return floors.join(chosen.withColumn("_more", F.lit(1)), "_id", "left").withColumn("whole", F.col("_floor") + more).drop(
        "_id", "_floor", "_frac", "_more")


def _digits(fraction: Column, tie: Column):
    """Ever finer parts of the order (fraction descending, tie ascending): (digit, whether larger ones come first)."""
    for level in range(1, 6):
        yield F.floor(fraction * float(FRACTION_BUCKETS) ** level), True
    yield fraction, True
    for at in range(1, 256):
        yield F.ascii(F.substring(tie, at, 1)), False


def target_weights(holdings: DataFrame, mode: str, posture: Column | None = None, total: str | None = None,
                   risk_cap: float = 0.15, opp_cap: float = 0.30, regime_cap: float = 0.15) -> DataFrame:
    """Weights per (portfolio, account, axis) cell, each cell conserving its dollars.

    Reads target_usd, vol, tilt, opportunity and role/axis. Research mode applies the risk tilt only;
    signal mode adds the opportunity tilt, and the regime tilt in the tax-free account. Diversifiers
    get the risk tilt in both. `total` names a live value per row to size the cells by.
    """
    out = targets_by_mode(holdings, [mode], posture, total, risk_cap, opp_cap, regime_cap)
    return out.withColumnsRenamed({f"{mode}_factor": "factor", f"{mode}_weight": "weight_in_cell", f"{mode}_usd": "target_usd"})


def targets_by_mode(holdings: DataFrame, modes: list[str], posture: Column | None = None, total: str | None = None,
                    risk_cap: float = 0.15, opp_cap: float = 0.30, regime_cap: float = 0.15) -> DataFrame:
    """The target weights of several modes side by side, from one pass: `<mode>_factor`, `<mode>_weight` and
    `<mode>_usd`. Cells are looked up by portfolio, so holdings that lie together by portfolio stay where they are."""
    held = holdings.where(F.col("target_usd") > 0).withColumn("axis", sleeve_axis(F.col("axis"), F.col("role")))
    rows = risk_factors(held, risk_cap)
    for mode in modes:
        factor = F.col("risk_factor")
        if mode == "signal":
            regime = F.when(F.col("account") == "ira", regime_factor(F.col("tilt"), posture, regime_cap)).otherwise(1.0)
            factor = F.when(F.col("axis") == "diversifier", factor).otherwise(
                factor * opportunity_factor(F.col("opportunity"), opp_cap) * regime)
        rows = rows.withColumn(f"{mode}_factor", factor).withColumn(f"_raw_{mode}", F.col("target_usd") * F.col(f"{mode}_factor"))
    out = with_cells(rows, CELL[:1], CELL[1:], _usd=half_up(F.round(F.sum(total or "target_usd"), 6)),
                     **{f"_sum_{mode}": F.sum(f"_raw_{mode}") for mode in modes})
    for mode in modes:
        out = out.withColumn(f"{mode}_weight", ratio(f"_raw_{mode}", f"_sum_{mode}")).withColumn(
            "_exact", F.col("_usd") * F.col(f"{mode}_weight"))
        out = largest_remainder(out, CELL, "_exact", "_usd", "ticker", sizes=held).withColumnRenamed("whole", f"{mode}_usd").drop(
            "_exact", f"_raw_{mode}", f"_sum_{mode}")
    return out.withColumnRenamed("target_usd", "base_usd").drop("_usd")


def rebalance_rows(targets: DataFrame) -> DataFrame:
    """Buy, trim or hold per target, against `current_usd` (the base target where absent). A taxable
    trim acts only with `trim_ok`; otherwise the ideal is shown and nothing is done."""
    current = F.coalesce("current_usd", "base_usd").cast("double")
    delta = F.round(F.col("target_usd") - current, 0).cast("bigint")
    blocked = (delta < 0) & (F.col("account") == "taxable") & ~F.coalesce("trim_ok", F.lit(False))
    action = (F.when(delta > 0, "buy").when(blocked, "hold (anchor - trim bar not met)")
              .when((delta < 0) & (F.col("account") == "ira"), "trim (funds buys)")
              .when(delta < 0, "trim (high-conviction)").otherwise("hold"))
    return targets.select(
        "portfolio_id", "account", "axis", "ticker", (F.col("weight_in_cell") * 100).alias("target_weight"),
        F.round(current, 0).cast("bigint").alias("current_usd"), "target_usd", delta.alias("delta_usd"),
        F.when(blocked, F.lit(0).cast("bigint")).otherwise(delta).alias("actioned_usd"), action.alias("action"))


def rebalance_summary(rows: DataFrame, cash: DataFrame) -> DataFrame:
    """Totals per portfolio and the new cash needed: each account's buys beyond its own sells and
    cash (portfolio_id, account, cash_usd)."""
    delta, acted = F.col("delta_usd"), F.col("actioned_usd")
    zero = F.lit(0).cast("bigint")
    per = rows.groupBy("portfolio_id", "account").agg(
        F.sum(F.when(delta > 0, delta).otherwise(zero)).alias("buy"),
        F.sum(F.when(acted < 0, -acted).otherwise(zero)).alias("sell"),
        F.sum(F.when((delta < 0) & (acted == 0), -delta).otherwise(zero)).alias("blocked"))
    need = F.greatest(zero, F.col("buy") - F.col("sell") - F.coalesce("cash_usd", zero))
    return per.join(cash, ["portfolio_id", "account"], "left").groupBy("portfolio_id").agg(
        F.sum("buy").alias("buy_usd"), F.sum("sell").alias("sell_usd"),
        (F.sum("buy") - F.sum("sell")).alias("net_usd"), F.sum("blocked").alias("blocked_trim_usd"),
        F.sum(need).alias("needs_new_cash_usd"))


def tilt_deltas(holdings: DataFrame, posture: Column, max_delta: float = 0.25) -> DataFrame:
    """Bounded change per holding from its tilt: additions only in a risk-on posture, taxable never."""
    tilt = F.coalesce("tilt", F.lit("n/a"))
    direction = F.when((tilt == "overweight") & (posture == "risk-on"), 1).when(tilt == "underweight", -1).otherwise(0)
    active = F.col("account") == "ira"
    delta = F.when(active, direction * max_delta).otherwise(0.0)
    action = (F.when(~active, "hold (taxable anchor)").when(delta > 0, "add").when(delta < 0, "trim").otherwise("hold"))
    return holdings.select("portfolio_id", "account", "ticker", tilt.alias("tilt"),
                           (delta * 100).alias("delta_pct"), action.alias("action"))


def drift_flags(positions: DataFrame, band: float = 0.25) -> DataFrame:
    """Live weight against target weight among priced, targeted positions; flagged beyond the band."""
    valid = positions.where((F.col("price") > 0) & (F.col("shares") > 0) & (F.col("target_usd") > 0)).withColumn(
        "_mv", F.col("price") * F.col("shares"))
    rows = with_group(valid, ["portfolio_id"], _all=F.sum("_mv"), _target=F.sum("target_usd"))
    weight, target = F.col("_mv") / F.col("_all"), F.col("target_usd") / F.col("_target")
    drift = weight / target - 1
    flagged = F.abs(drift) > band
    return rows.select(
        "portfolio_id", "ticker", (weight * 100).alias("weight"), (target * 100).alias("target_weight"),
        (drift * 100).alias("drift"), flagged.alias("flagged"),
        F.when(flagged & (drift > 0), "trim").when(flagged, "add").otherwise("hold").alias("action"))


def cut_or_trim(holdings: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply cut (to zero) or trim (to two thirds) edits (ticker, edit) and restore each axis's total.

    If an axis is emptied, the rest is normalised to one instead. Portfolios that hold none of the
    names, or would be left empty, are unchanged. Holdings need weight, axis/role and sleeve_usd.
    """
    marked = holdings.join(edits, "ticker", "left").withColumn("_axis", sleeve_axis(F.col("axis"), F.col("role")))
    w = F.coalesce("weight", F.lit(0.0))
    edited = F.when(F.col("edit") == "cut", 0.0).when(F.col("edit") == "trim", fixed(w * (2 / 3), 4)).otherwise(w)
    marked = marked.withColumn("_w", w).withColumn("_e", edited)
    is_div = F.col("_axis") == "diversifier"
    # weights carry four decimals, so rounding their sums removes only the noise of the summation order
    side = lambda c, d: F.round(F.sum(F.when(is_div == d, F.col(c)).otherwise(0.0)), 6)
    rows = with_group(marked, ["portfolio_id"],
                      _hit=F.max(F.col("edit").isNotNull() & (F.col("_w") > 0)),
                      _bd=side("_w", True), _bb=side("_w", False), _ad=side("_e", True), _ab=side("_e", False))
    total = F.col("_ad") + F.col("_ab")
    applies = F.col("_hit") & (total > 0)
    survive = ((F.col("_bb") == 0) | (F.col("_ab") > 0)) & ((F.col("_bd") == 0) | (F.col("_ad") > 0))
    before = F.when(is_div, F.col("_bd")).otherwise(F.col("_bb"))
    after = F.when(is_div, F.col("_ad")).otherwise(F.col("_ab"))
    new = F.when(survive, fixed(F.col("_e") * F.coalesce(ratio(before, after), F.lit(1.0)), 4)).otherwise(
        fixed(F.col("_e") / total, 4))
    return rows.where(~applies | (F.col("_e") > 0)).select(
        "portfolio_id", "account", "ticker", F.when(applies, new).otherwise(F.col("_w")).alias("weight"),
        F.when(applies, half_up(new * F.col("sleeve_usd"))).otherwise(F.col("target_usd")).alias("target_usd"))


def stress(valued: DataFrame, scenarios: list[dict] = SCENARIOS, limit: float = 0.35) -> DataFrame:
    """Portfolio value under each scenario. `valued` has portfolio_id, ticker, usd and a nullable beta;
    an override for a name replaces market times beta. The few scenarios are expanded per row, and the
    sums combine before the shuffle."""
    table = F.array(*[
        F.struct(F.lit(s["id"]).alias("scenario"), F.lit(float(s["market"])).alias("market"),
                 F.lit(float(s["beta"])).alias("beta")) for s in scenarios])
    override = F.lit(None).cast("double")
    for s in scenarios:
        for ticker, shock in s["targeted"].items():
            override = F.when((F.col("_s.scenario") == s["id"]) & (F.col("ticker") == ticker), shock).otherwise(override)
    rows = valued.where(F.col("usd") > 0).withColumn("_s", F.explode(table))
    beta = F.when(F.col("beta") >= 0, F.col("beta")).otherwise(F.col("_s.beta"))
    rows = rows.withColumn("_change", F.coalesce(override, F.col("_s.market") * beta))
    out = rows.groupBy("portfolio_id", F.col("_s.scenario").alias("scenario")).agg(
        F.sum("usd").alias("before"), F.sum(F.col("usd") * (1 + F.col("_change"))).alias("after"))
    drawdown = F.col("after") / F.col("before") - 1
    return out.withColumn("drawdown", drawdown).withColumn("breaches_35", drawdown <= -limit)


def dca_progress(holdings: DataFrame, positions: DataFrame) -> DataFrame:
    """Deployed cost against the planned amount per portfolio and name."""
    plan = holdings.groupBy("portfolio_id", "ticker").agg(F.sum("target_usd").alias("target"), F.min("tier").alias("tier"))
    deployed = F.when((F.col("shares") > 0) & (F.col("cost_basis") > 0), F.col("shares") * F.col("cost_basis")).otherwise(0.0)
    rows = plan.join(positions.select("portfolio_id", "ticker", "shares", "cost_basis"), ["portfolio_id", "ticker"], "left")
    pct = F.least(F.lit(100).cast("bigint"), half_up(ratio(deployed * 100, F.col("target").cast("double"))))
    return rows.select("portfolio_id", "ticker", "tier", "target", half_up(deployed).alias("deployed"),
                       F.coalesce(pct, F.lit(0).cast("bigint")).alias("pct"))


def dca_schedule(holdings: DataFrame) -> DataFrame:
    """Instalments per holding by tier: A and D at once, B half now and three months, C a quarter now
    and nine months, anything else held. Month 0 is now; the last instalment takes the remainder."""
    tier, target = F.col("tier"), F.coalesce("target_usd", F.lit(0)).cast("double")
    share_now = F.when(tier.isin("A", "D"), 1.0).when(tier == "B", 0.5).when(tier == "C", 0.25).otherwise(0.0)
    months = F.when(tier == "B", 3).when(tier == "C", 9).otherwise(0)
    later = half_up(target * F.when(months > 0, 1 - share_now).otherwise(0.0))
    rows = holdings.withColumns({"_now": half_up(target * share_now), "_months": months, "_later": later}).withColumn(
        "month", F.explode(F.sequence(F.lit(0), F.col("_months"))))
    each = F.floor(F.col("_later") / F.greatest("_months", F.lit(1))).cast("bigint")
    amount = (F.when(F.col("month") == 0, F.col("_now"))
              .when(F.col("month") < F.col("_months"), each)
              .otherwise(F.col("_later") - each * (F.col("_months") - 1)))
    return rows.withColumn("amount", amount).drop("_now", "_months", "_later")
