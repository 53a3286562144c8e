"""Column helpers shared by the operators. All stay in JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSIONS_PER_YEAR = 252


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column | str) -> Column:
    """Round to whole numbers, halves toward +infinity."""
    return F.floor(col(x) + F.lit(0.5)).cast("bigint")


def fixed(x: Column | str, digits: int) -> Column:
    """Round to a number of decimals, halves of the binary value toward +infinity."""
    scale = float(10 ** digits)
    return F.floor(col(x) * scale + F.lit(0.5)) / F.lit(scale)


def clamp(x: Column | str, low: float | Column, high: float | Column) -> Column:
    """Bound x to [low, high]; null stays null."""
    x = col(x)
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is zero or either side is null."""
    return F.try_divide(col(a), col(b))


def change(new: Column | str, old: Column | str) -> Column:
    """Simple return; null unless the old value is positive."""
    old = col(old)
    return F.when(old > 0, col(new) / old - 1)


def positive(x: Column | str) -> Column:
    """Keep finite values above zero, else null. Text is parsed leniently."""
    n = col(x).try_cast("double")
    return F.when((n > 0) & ~F.isnan(n) & (n < F.lit(float("inf"))), n)


def is_weekend(d: Column | str) -> Column:
    return F.dayofweek(col(d)).isin(1, 7)


def upper_middle(x: str) -> Column:
    """Aggregate: sorted[floor(n/2)], the upper of the two middles when n is even."""
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -({x}))")


def lower_middle(x: str) -> Column:
    """Aggregate: sorted[floor((n-1)/2)], the lower of the two middles when n is even."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})")


def lookup(key: Column | str, table: dict, default: float | None = None) -> Column:
    """Value of a small fixed table, with a default for unknown or null keys."""
    key = col(key)
    pairs = list(table.items())
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), pairs[1:],
                 F.when(key == pairs[0][0], F.lit(pairs[0][1])))
    return out.otherwise(F.lit(default))


def ordinal(key: Column | str, levels: list[str]) -> Column:
    """Position of a value in an ordered enum; null when unknown."""
    return lookup(key, {v: i for i, v in enumerate(levels)})


def either_null(a: Column, b: Column, value: Column) -> Column:
    """Suppress: null as soon as one input is null, unlike SQL's false AND null."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregation combines map-side, and the join back can be split by adaptive skew handling, so one
    group that holds a large share of the rows never has to sit in a single window task.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, keys, "inner")


def with_cells(df: DataFrame, keys: list[str], inner: list[str], **aggs: Column) -> DataFrame:
    """Attach the aggregates of each (keys, inner) cell to its rows, for keys that have few cells each. The join is on
    `keys` alone, so rows that lie together by `keys` are not dealt again."""
    stats = df.groupBy(*keys, *inner).agg(*[c.alias(n) for n, c in aggs.items()])
    cells = stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct(*inner), F.struct(*aggs)))).alias("_cells"))
    own = F.element_at("_cells", F.struct(*inner))
    return df.join(cells, keys, "inner").withColumns({n: own[n] for n in aggs}).drop("_cells")


def monotone_bucket(x: Column | str, buckets: int = 4096, scale: float = 8.0) -> Column:
    """A fixed order-preserving bucket number, used to rank without a single-task sort."""
    return F.floor((F.atan(col(x) * scale) / F.lit(3.141592653589793) + 0.5) * buckets).cast("int")


def average_rank(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Rank all rows of a frame by value, ties sharing their average rank.

    Values are first collapsed to (value, count). An order-preserving bucket splits the axis; only
    the bucket totals (at most `buckets` rows) are accumulated in one place, then every bucket is
    ranked on its own.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_b", monotone_bucket(value))
    totals = counts.groupBy("_b").agg(F.sum("_n").alias("_bn"))
    before = totals.select(
        "_b", (F.sum("_bn").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
               - F.col("_bn")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.join(before, "_b")
        .withColumn("_upto", F.sum("_n").over(inside))
        .select(value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(rank))
    )
    return df.join(ranked, value)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Presentation step: round the floating columns of a result."""
    out = []
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(field.name), special.get(field.name, digits)).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)
