"""Putting several series on common dates.

A set of series is a long frame (grp, ticker, d, close); each group is aligned on its own. Common
dates are found by counting (relational division), never by collecting dates into lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import change


def usable_members(series: DataFrame, min_points: int = 2) -> DataFrame:
    """(grp, ticker) pairs with enough points to count as members."""
    return (series.groupBy("grp", "ticker").agg(F.count("*").alias("_n"))
            .where(F.col("_n") >= min_points).select("grp", "ticker"))


def align(series: DataFrame, min_points: int = 2) -> DataFrame:
    """The rows of the members on the dates on which every member of the group has a close.

    Both counts run over bounded partitions (days of a ticker, members on a day), so the rows are
    carried along instead of being joined back; only the group width is a join, with one row a group.
    """
    per_member = F.count("*").over(Window.partitionBy("grp", "ticker"))
    kept = series.withColumn("_points", per_member).where(F.col("_points") >= min_points)
    width = usable_members(series, min_points).groupBy("grp").agg(F.count("*").alias("_width"))
    on_day = F.count("*").over(Window.partitionBy("grp", "d"))
    return (kept.withColumn("_n", on_day).join(width, "grp")
            .where(F.col("_n") == F.col("_width")).drop("_points", "_n", "_width"))


def common_dates(series: DataFrame, min_points: int = 2) -> DataFrame:
    return align(series, min_points).select("grp", "d").distinct()


def basket_index(series: DataFrame, weight: str | None = None) -> DataFrame:
    """Weighted index per group on its common dates, 100 at the first one: (grp, d, value)."""
    w = F.col(weight) if weight else F.lit(1.0)
    positive = series.withColumn("_w", w.cast("double")).where(F.col("_w") > 0)
    rows = align(positive, min_points=1)
    member = Window.partitionBy("grp", "ticker")
    based = (rows.withColumn("_base", F.first("close").over(member.orderBy("d")))
             .withColumn("_days", F.count("*").over(member)).where(F.col("_days") >= 2))
    return based.groupBy("grp", "d").agg(
        (F.lit(100.0) * F.sum(F.col("_w") * F.col("close") / F.col("_base")) / F.sum("_w")).alias("value"))


def basket_returns(series: DataFrame, min_dates: int = 30) -> DataFrame:
    """Equal-weight daily return per group over its common dates: (grp, d, ret)."""
    rows = align(series)
    w = Window.partitionBy("grp", "ticker").orderBy("d")
    moves = rows.withColumn("_r", change("close", F.lag("close").over(w)))
    daily = moves.groupBy("grp", "d").agg(F.avg("_r").alias("ret"))
    enough = daily.groupBy("grp").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_dates)
    return daily.where(F.col("ret").isNotNull()).join(enough, "grp", "left_semi")


def blend(indices: DataFrame, min_dates: int = 60, min_parts: int = 2) -> DataFrame:
    """Equal mix of several basket indices (grp, part, d, value), rebased to 100 at the common start."""
    rows = align(indices.select("grp", F.col("part").alias("ticker"), "d", F.col("value").alias("close")))
    base = rows.groupBy("grp", "ticker").agg(F.min_by("close", "d").alias("_base"), F.count("*").alias("_n"))
    fit = base.groupBy("grp").agg(F.count("*").alias("_parts"), F.min("_n").alias("_dates")).where(
        (F.col("_parts") >= min_parts) & (F.col("_dates") >= min_dates))
    return (rows.join(base, ["grp", "ticker"]).join(fit, "grp", "left_semi")
            .groupBy("grp", "d").agg((F.lit(100.0) * F.avg(F.col("close") / F.col("_base"))).alias("value")))


def date_axis(series: DataFrame) -> DataFrame:
    """Dense index of all dates. The window has no partition, but it runs over distinct days only."""
    return series.select("d").distinct().withColumn(
        "idx", F.row_number().over(Window.orderBy("d")) - 1)


def offset_returns(series: DataFrame, axis: DataFrame, sessions: int, out: str) -> DataFrame:
    """Return over the last `sessions` positions of the shared date axis; a ticker without a close at
    both ends has none (no forward fill). Joined on the shifted index, not on a range."""
    placed = series.join(axis, "d").select("ticker", "idx", "close")
    earlier = placed.select("ticker", (F.col("idx") + sessions).alias("idx"), F.col("close").alias("_then"))
    return placed.join(earlier, ["ticker", "idx"]).select(
        "ticker", "idx", change("close", "_then").alias(out))
