"""Per-ticker technicals from daily closes.

Input frames are long: (ticker, d, close) with one row per ticker and day, so the largest window
partition is bounded by the number of calendar days whatever the size of the table. Every window
uses the same partitioning and order: one shuffle and one sort feed all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import SESSIONS_PER_YEAR, ratio

YEAR, MONTH = 252, 22

def by_ticker():
    return Window.partitionBy("ticker").orderBy("d")


def trailing(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def sma(n: int, price: str = "close") -> Column:
    """Mean of the last n closes, null until n closes exist. Needs the `bar` column."""
    return F.when(F.col("bar") >= n, F.avg(price).over(trailing(n)))


def realized_vol(n: int, log_return: str = "log_ret") -> Column:
    """Annualised deviation of the last n log returns; needs n+1 closes."""
    return F.when(F.col("bar") > n,
                  F.stddev_samp(log_return).over(trailing(n)) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))))


def with_bars(bars: DataFrame) -> DataFrame:
    """Add the bar number, the previous close and the log return."""
    w = by_ticker()
    return (
        bars.withColumn("bar", F.row_number().over(w))
        .withColumn("prev", F.lag("close").over(w))
        .withColumn("log_ret", F.ln(F.col("close") / F.col("prev")))
    )


def series(bars: DataFrame) -> DataFrame:
    """Every technical on every bar."""
    w = by_ticker()
    year = F.year("d")
    new_year = F.coalesce(year != F.year(F.lag("d").over(w)), F.lit(True))
    base = (
        with_bars(bars)
        .withColumn("_year_base", F.when(new_year, F.col("close")))
        .withColumn("_ytd_base", F.last("_year_base", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("price", F.col("close"))
        .withColumn("high52", F.max("close").over(trailing(YEAR)))
        .withColumn("ma20", sma(20)).withColumn("ma50", sma(50)).withColumn("ma200", sma(200))
        .withColumn("_c12", F.lag("close", YEAR).over(w))
        .withColumn("_c1", F.lag("close", MONTH).over(w))
        .withColumn("vol_3m", realized_vol(63)).withColumn("vol_1y", realized_vol(YEAR))
    )
    p = F.col("price")
    return base.select(
        "ticker", "d", "bar", "price", "high52",
        (p / F.col("high52") - 1).alias("pct_off_high"),
        (p / F.col("_ytd_base") - 1).alias("ytd"),
        "ma20", "ma50", "ma200",
        (p / F.col("ma50") - 1).alias("pct_vs_ma50"),
        (p / F.col("ma200") - 1).alias("pct_vs_ma200"),
        (p >= F.col("ma200")).alias("above_ma200"),
        (p >= F.col("ma20")).alias("above_ma20"),
        (p / F.col("_c12") - 1).alias("mom_12m"),
        (p / F.col("_c1") - 1).alias("mom_1m"),
        "vol_3m", "vol_1y")


def snapshot(bars: DataFrame) -> DataFrame:
    """The last bar of every ticker with its technicals.

    Only the tail of each series matters here, so the trailing windows become conditional aggregates
    over the distance from the last bar: one pass per ticker instead of one frame per row.
    """
    whole = Window.partitionBy("ticker")
    tail = (
        with_bars(bars)
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_last", F.max("d").over(whole))
        .withColumn("_back", F.col("_n") - F.col("bar"))
    )
    back, close, n = F.col("_back"), F.col("close"), F.max("_n")

    def mean(k):
        return F.when(n >= k, F.avg(F.when(back < k, close)))

    def vol(k):
        return F.when(n > k, F.stddev_samp(F.when(back < k, F.col("log_ret")))
                      * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))))

    p = F.col("price")
    return (
        tail.groupBy("ticker").agg(
            F.max("_last").alias("as_of"), n.alias("bar"),
            F.max(F.when(back == 0, close)).alias("price"),
            F.max(F.when(back < YEAR, close)).alias("high52"),
            F.min_by(F.when(F.year("d") == F.year("_last"), close),
                     F.when(F.year("d") == F.year("_last"), F.col("d"))).alias("_ytd_base"),
            mean(20).alias("ma20"), mean(50).alias("ma50"), mean(200).alias("ma200"),
            F.max(F.when(back == YEAR, close)).alias("_c12"), F.max(F.when(back == MONTH, close)).alias("_c1"),
            vol(63).alias("vol_3m"), vol(YEAR).alias("vol_1y"),
            *[wilder(p, close - F.col("prev"), F.col("bar") - 1, F.col("_n") - 1).alias(f"rsi_{p}") for p in (14, 10)])
        .select(
            "ticker", "as_of", "bar", "price", "high52",
            (p / F.col("high52") - 1).alias("pct_off_high"), (p / F.col("_ytd_base") - 1).alias("ytd"),
            "ma20", "ma50", "ma200",
            (p / F.col("ma50") - 1).alias("pct_vs_ma50"), (p / F.col("ma200") - 1).alias("pct_vs_ma200"),
            (p >= F.col("ma200")).alias("above_ma200"), (p >= F.col("ma20")).alias("above_ma20"),
            (p / F.col("_c12") - 1).alias("mom_12m"), (p / F.col("_c1") - 1).alias("mom_1m"),
            "vol_3m", "vol_1y", "rsi_14", "rsi_10")
    )


def finite(close: Column) -> Column:
    return F.coalesce(~F.isnan(close) & (F.abs(close) < float("inf")), F.lit(False))


def wilder(period: int, x: Column, i: Column, n: Column) -> Column:
    """Wilder's index at the last bar as an aggregate over changes x, each with its place i of n.

    The smoothing recurrence is a geometric weighting of the gains: with a = (p-1)/p the first p
    changes weigh a^(N-p) each and change i weighs a^(N-i) after that. No losses at all gives 100; fewer
    than p changes, or a close that is missing or not finite anywhere, gives null.
    """
    weight = F.pow(F.lit((period - 1) / period), (n - F.greatest(i, F.lit(period))).cast("double"))
    gain = F.sum(weight * F.greatest(x, F.lit(0.0)))
    loss = F.sum(weight * F.greatest(-x, F.lit(0.0)))
    quiet = F.sum(F.greatest(-x, F.lit(0.0))) == 0
    value = F.when(quiet, F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    return F.when((F.max(n) >= period) & (F.count_if(~finite(F.col("close"))) == 0), value)


def rsi(bars: DataFrame, *periods: int) -> DataFrame:
    """Wilder's index at the last bar, one column per period."""
    w = by_ticker()
    whole = Window.partitionBy("ticker")
    moves = (
        bars.withColumn("_x", F.col("close") - F.lag("close").over(w))
        .withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole) - 1)
    )
    return moves.groupBy("ticker").agg(*[
        wilder(p, F.col("_x"), F.col("_i"), F.col("_n")).alias(f"rsi_{p}") for p in periods])


def rsi_series(bars: DataFrame, period: int = 14, block: int = 512) -> DataFrame:
    """Wilder's index on every bar; null until warm, and for a ticker with a close that is not finite.

    Each average is the one before times (period - 1) / period plus a share of the new move: a linear
    recurrence, solved as a scan in blocks. Within a block the weighted moves are summed by a window; the
    factor that a block's weights span stays far inside a double, and as no move is negative nothing cancels.
    What a block hands on is one row, the rows of a ticker are folded in order, and each block gets the
    carry it starts from by a join."""
    w, keep = by_ticker(), (period - 1) / period
    move = F.col("close") - F.lag("close").over(w)
    sides = {"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0))}
    finite = F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf"))
    whole = Window.partitionBy("ticker")
    rows = bars.select("ticker", "d", "close").withColumns({
        "i": F.row_number().over(w) - 1, "ok": F.min(finite).over(whole), **sides}).withColumn("place", F.col("i") - period)
    seed = w.rowsBetween(-(period - 1), 0)
    rows = rows.withColumns({c: F.when(F.col("place") == 0, F.sum(c).over(seed) / period).otherwise(F.col(c) / period) for c in sides})
    rows = rows.withColumns({"block": F.floor(F.col("place") / block), "k": F.pmod(F.col("place"), F.lit(block))})
    inside = Window.partitionBy("ticker", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(keep), F.col("k"))
    warm = rows.where("ok and place >= 0").withColumns({c: power * F.sum(F.col(c) / power).over(inside) for c in sides})
    handed = warm.where(F.col("k") == block - 1).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("block", *sides))).alias("ends"))
    none = F.struct(F.lit(-1).cast("long").alias("block"), *[F.lit(0.0).alias(c) for c in sides])
    step = lambda done, e: F.array_append(done, F.struct(
        e["block"].alias("block"), *[(e[c] + F.element_at(done, -1)[c] * keep ** block).alias(c) for c in sides]))
    carried = handed.select("ticker", F.inline(F.aggregate("ends", F.array(none), step)).alias("block", *[f"{c}_in" for c in sides])) \
        .withColumn("block", F.col("block") + 1)
    average = {c: F.col(c) + power * keep * F.coalesce(f"{c}_in", F.lit(0.0)) for c in sides}
    known = warm.join(carried, ["ticker", "block"], "left").withColumns(average).select(
        "ticker", "d", F.when(F.col("loss") > 0, 100 - 100 / (1 + F.col("gain") / F.col("loss"))).otherwise(100.0).alias("rsi"))
    return rows.where("not ok or place < 0").select("ticker", "d", F.lit(None).cast("double").alias("rsi")).unionByName(known)


def append_today(history: DataFrame, today: DataFrame, min_bars: int = 60) -> DataFrame:
    """Deep history joined with today's price (ticker, d, price): newer appends, same day replaces,
    older than the tail or fewer than `min_bars` bars drops the ticker."""
    tail = history.groupBy("ticker").agg(F.max("d").alias("_tail"), F.count("*").alias("_n"))
    live = (
        today.where(F.col("price") > 0).join(tail, "ticker")
        .where(F.col("d") >= F.col("_tail"))
        .withColumn("_total", F.col("_n") + (F.col("d") > F.col("_tail")).cast("int"))
        .where(F.col("_total") >= min_bars)
        .select("ticker", F.col("d").alias("_today"), F.col("price").alias("_price"))
    )
    kept = history.join(live, "ticker").where(F.col("d") < F.col("_today")).select("ticker", "d", "close")
    return kept.unionByName(live.select("ticker", F.col("_today").alias("d"), F.col("_price").alias("close")))
