"""Change history of theme labels and first-seen state of evidence (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ["priced_in", "bind_window", "non_consensus"]


def label_changes(snapshots: DataFrame, key: str = "theme") -> DataFrame:
    """Of the daily snapshots (theme, d, labels), the ones where a label changed."""
    w = Window.partitionBy(key).orderBy("d")
    same = F.lit(True)
    for c in LABELS:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return snapshots.withColumn("_keep", first | ~same).where("_keep").select(key, "d", *LABELS)


def drift(snapshots: DataFrame, key: str = "theme") -> DataFrame:
    """Themes whose latest priced_in or bind_window differs from the first record."""
    ends = snapshots.groupBy(key).agg(
        F.min("d").alias("since"),
        *[F.min_by(c, "d").alias(f"{c}_from") for c in LABELS[:2]], *[F.max_by(c, "d").alias(f"{c}_to") for c in LABELS[:2]])
    moved = ~F.col("priced_in_from").eqNullSafe(F.col("priced_in_to")) | ~F.col("bind_window_from").eqNullSafe(F.col("bind_window_to"))
    return ends.where(moved)


def mark_new(items: DataFrame, seen: DataFrame, today: Column, keep_days: int = 90) -> DataFrame:
    """Add `is_new`: the key (key, d) is not in the state of the last `keep_days` days."""
    live = seen.where(F.col("d") >= F.date_sub(today, keep_days)).select("key").distinct().withColumn("_seen", F.lit(True))
    return items.join(live, "key", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def advance_seen(items: DataFrame, seen: DataFrame, today: Column, keep_days: int = 90) -> DataFrame:
    """State after this run: latest date per key, without keys older than `keep_days`."""
    both = seen.select("key", "d").unionByName(items.select("key", F.coalesce("d", today).alias("d")))
    return both.groupBy("key").agg(F.max("d").alias("d")).where(F.col("d") >= F.date_sub(today, keep_days))


def filing_key(ticker: Column, form: Column, d: Column) -> Column:
    return F.concat_ws(":", ticker, form, d.cast("string"))


def form_key(ticker: Column, form: Column) -> Column:
    """Key of a filer's kind of filing, whatever its day."""
    return F.concat_ws(":", F.lit("f"), ticker, form)


def title_key(title: Column) -> Column:
    """Stable key of a headline, whatever its case."""
    return F.xxhash64(F.lower(title))


def split_candidates(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """Add `fresh` to candidates (id, evidence_hash): unknown ids, and rejected ones whose evidence
    changed. Memory has id, status, evidence_hash."""
    past = memory.select("id", F.col("status").alias("_status"), F.col("evidence_hash").alias("_hash"))
    again = (F.col("_status") == "rejected") & ~F.col("_hash").eqNullSafe(F.col("evidence_hash"))
    return candidates.join(past, "id", "left").withColumn(
        "fresh", F.col("_status").isNull() | F.coalesce(again, F.lit(False))).drop("_status", "_hash")


def remember(memory: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Memory with this run's verdicts laid over it."""
    both = memory.select("id", "status", "evidence_hash", F.lit(0).alias("_new")).unionByName(
        verdicts.select("id", "status", "evidence_hash", F.lit(1).alias("_new")))
    best = F.max_by(F.struct("status", "evidence_hash"), F.struct("_new", "status", "evidence_hash"))
    return both.groupBy("id").agg(best.alias("_b")).select("id", "_b.status", "_b.evidence_hash")
