"""Validation that reports every broken rule as rows instead of failing on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.votes import BIND, DURABILITY, PRICED, RISK

POSTURES = ["risk-on", "neutral", "defensive", "unknown"]


def filled(c: str) -> Column:
    return F.coalesce(F.length(F.col(c)) > 0, F.lit(False))


def number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def one_of(c: str, allowed: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(allowed), F.lit(False))


def optional(c: str, rule: Column) -> Column:
    return F.col(c).isNull() | rule


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, error) for every rule a row breaks. Rules must never be null."""
    errors = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(*keys, F.explode(errors).alias("error"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that appear more than once."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(
        key, F.lit("duplicate id").alias("error"))


def holdings(df: DataFrame) -> DataFrame:
    return violations(df, ["portfolio_id", "ticker"], {
        "ticker required": filled("ticker"), "account": one_of("account", ["ira", "taxable"]),
        "target_usd must be a number": number("target_usd"), "tier required": filled("tier"),
        "role required": filled("role"), "axis": optional("axis", one_of("axis", ["deep-tech", "diversifier"]))})


def positions(df: DataFrame) -> DataFrame:
    return violations(df, ["portfolio_id", "ticker"], {
        "shares must be a number": optional("shares", number("shares")),
        "cost_basis must be a number": optional("cost_basis", number("cost_basis")),
        "forward_pe must be a number or null": optional("forward_pe", number("forward_pe"))})


def securities(df: DataFrame) -> DataFrame:
    return violations(df, ["ticker"], {"type": one_of("type", ["etf", "stock", "adr"])})


def themes(df: DataFrame) -> DataFrame:
    rows = violations(df, ["theme"], {
        "id required": filled("theme"), "sector required": filled("sector"), "scarcity required": filled("scarcity"),
        "bind_window": one_of("bind_window", BIND), "priced_in": one_of("priced_in", PRICED),
        "durability": one_of("durability", DURABILITY), "substitution_risk": one_of("substitution_risk", RISK),
        "non_consensus must be a boolean": F.col("non_consensus").isNotNull(),
        "axis": optional("axis", one_of("axis", ["deep-tech", "diversifier"])),
        "confidence must be 0..1": optional("confidence", F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        "last_reviewed must be a date": optional("last_reviewed", F.col("last_reviewed").try_cast("date").isNotNull())})
    return rows.unionByName(duplicates(df, "theme"))


def triggers(df: DataFrame) -> DataFrame:
    rows = violations(df, ["trigger"], {
        "id required": filled("trigger"), "name required": filled("name"), "type": one_of("type", ["auto", "manual"]),
        "status": one_of("status", ["armed", "monitor", "fired"]), "action required": filled("action"),
        "threshold must be a number": optional("threshold", F.col("threshold").try_cast("double").isNotNull())})
    return rows.unionByName(duplicates(df, "trigger"))


def quotes(df: DataFrame) -> DataFrame:
    """A published quote has a price or says why it has none; the posture is a known one."""
    return violations(df, ["ticker"], {
        "price or error required": number("price") | filled("error"),
        "posture": optional("posture", one_of("posture", POSTURES))})


def unresolved(tickers: DataFrame, published: DataFrame) -> DataFrame:
    """Tradeable holdings that are neither priced nor reported as failed."""
    return tickers.select("ticker").distinct().join(
        published.where(F.col("price").isNotNull() | F.col("error").isNotNull()).select("ticker"), "ticker", "left_anti")
