"""Return and risk metrics of value series, one group per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import SESSIONS_PER_YEAR, change, ratio

METRICS = ["cagr", "max_drawdown", "calmar", "sortino", "sharpe", "vol", "breaches_35"]


def value_metrics(df: DataFrame, keys: list[str], values: list[str], order: str = "d",
                  periods: int = SESSIONS_PER_YEAR, limit: float = 0.35, digits: int | None = None) -> DataFrame:
    """Metrics of each value column, as `<column>_<metric>`, plus `n`.

    One window spec serves all columns, and the aggregation reuses its partitioning. Ratios are null,
    never infinite, when their denominator is zero. `digits` rounds to presentation precision.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    work = df
    for v in values:
        peak = F.max(v).over(so_far)
        work = (work.withColumn(f"_r_{v}", change(v, F.lag(v).over(w)))
                .withColumn(f"_dd_{v}", F.when(peak > 0, 1 - F.col(v) / peak)))
    aggs = [F.count("*").alias("n")]
    root = F.sqrt(F.lit(float(periods)))
    for v in values:
        r = F.col(f"_r_{v}")
        aggs += [
            F.min_by(v, order).alias(f"_first_{v}"), F.max_by(v, order).alias(f"_last_{v}"),
            F.greatest(F.max(f"_dd_{v}"), F.lit(0.0)).alias(f"_mdd_{v}"),
            F.coalesce(F.avg(r), F.lit(0.0)).alias(f"_mean_{v}"),
            (F.when(F.count(r) >= 2, F.stddev_samp(r)) * root).alias(f"_vol_{v}"),
            (F.sqrt(F.avg(F.when(r < 0, r * r).when(r >= 0, 0.0))) * root).alias(f"_down_{v}")]
    stats = work.groupBy(*keys).agg(*aggs)
    out = [*map(F.col, keys), F.col("n")]
    for v in values:
        first, last, mdd = F.col(f"_first_{v}"), F.col(f"_last_{v}"), F.col(f"_mdd_{v}")
        cagr = F.when((F.col("n") >= 2) & (first > 0),
                      F.pow(last / first, F.lit(float(periods)) / (F.greatest("n", F.lit(2)) - 1)) - 1)
        yearly = F.col(f"_mean_{v}") * periods
        parts = {
            "cagr": cagr, "max_drawdown": mdd, "calmar": ratio(cagr, mdd),
            "sortino": ratio(yearly, F.col(f"_down_{v}")), "sharpe": ratio(yearly, F.col(f"_vol_{v}")),
            "vol": F.col(f"_vol_{v}")}
        out += [(F.round(c, digits) if digits is not None else c).alias(f"{v}_{m}") for m, c in parts.items()]
        out.append((mdd >= limit).alias(f"{v}_breaches_35"))
    return stats.select(*out)


def series_metrics(df: DataFrame, keys: list[str], value: str = "value", **options) -> DataFrame:
    """Metrics of one value column without the column prefix."""
    out = value_metrics(df, keys, [value], **options)
    return out.select(*keys, "n", *[F.col(f"{value}_{m}").alias(m) for m in METRICS])


def basket_stats(index: DataFrame, key: str = "grp", min_points: int = 60) -> DataFrame:
    """Metrics of basket indices (grp, d, value) with their window; short ones are left out."""
    m = series_metrics(index, [key])
    span = index.groupBy(key).agg(F.min("d").alias("start_d"), F.max("d").alias("end_d"))
    return m.where(F.col("n") >= min_points).join(span, key).withColumn(
        "years", F.col("n") / F.lit(float(SESSIONS_PER_YEAR)))


def benchmark_excess(book: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """Total return of each book minus that of its benchmark over their own windows."""

    def total(df: DataFrame, out: str) -> DataFrame:
        first, last = F.min_by("value", "d"), F.max_by("value", "d")
        return df.groupBy(*keys).agg(
            F.when((F.count("*") > 1) & (first > 0), last / first - 1).alias(out))

    both = total(book, "asset_return").join(total(benchmark, "benchmark_return"), keys)
    return both.withColumn("excess", F.col("asset_return") - F.col("benchmark_return")).where(
        F.col("excess").isNotNull())


def years_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / F.lit(365.25)
