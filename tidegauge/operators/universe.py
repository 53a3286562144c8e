"""Which tickers are in play, and how they are named at each provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import lookup, with_group

# Tickers whose chart symbol differs from the shown one.
CHART_SYMBOLS = {"IVN": "IVN.TO", "LYC": "LYC.AX", "U.UN": "U-UN.TO"}


def is_tradeable(ticker: Column) -> Column:
    """Not empty, no parenthesised placeholder, not cash."""
    return ticker.isNotNull() & (F.length(ticker) > 0) & ~ticker.rlike("[()]") & ~ticker.rlike("(?i)^CASH")


def tradeable_universe(*ticker_frames: DataFrame) -> DataFrame:
    """Distinct tradeable tickers of several frames."""
    merged = ticker_frames[0].select("ticker")
    for frame in ticker_frames[1:]:
        merged = merged.unionByName(frame.select("ticker"))
    return merged.where(is_tradeable(F.col("ticker"))).distinct()


def chart_symbol(ticker: Column) -> Column:
    return F.coalesce(lookup(ticker, CHART_SYMBOLS, None), ticker)


def quote_symbol(ticker: Column) -> Column:
    """Index symbols and exchange-suffixed tickers are lowered as they are; the rest gets a suffix."""
    low = F.lower(ticker)
    return F.when(ticker.startswith("^") | ticker.contains("."), low).otherwise(F.concat(low, F.lit(".us")))


def composite_members(holdings: DataFrame, securities: DataFrame, min_etfs: int = 3) -> DataFrame:
    """Per portfolio: its ETFs when there are enough of them, else everything it holds."""
    typed = holdings.join(securities.select("ticker", "type"), "ticker", "left")
    is_etf = F.coalesce(F.col("type") == "etf", F.lit(False))
    counted = with_group(typed, ["portfolio_id"], _etfs=F.count_if(is_etf))
    return counted.where(is_etf | (F.col("_etfs") < min_etfs)).drop("_etfs")


def sleeve_axis(axis: Column, role: Column) -> Column:
    tagged = F.coalesce(axis == "diversifier", F.lit(False))
    by_role = F.coalesce(role.rlike("(?i)diversifier|de-correlator"), F.lit(False))
    return F.when(tagged | by_role, "diversifier").otherwise("deep-tech")
