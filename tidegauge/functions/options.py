"""Option pricing as column expressions; only the search for an implied volatility runs over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 0.04
# Coefficients of the five-term normal distribution approximation.
CDF_SCALE, CDF_DENSITY = 0.2316419, 0.3989422804014327
CDF_TERMS = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm_pdf(x: Column) -> Column:
    return F.lit(CDF_DENSITY) * F.exp(-x * x / 2)


def norm_cdf(x: Column) -> Column:
    def tail(k: Column) -> Column:
        series = F.lit(CDF_TERMS[-1])
        for c in reversed(CDF_TERMS[:-1]):
            series = F.lit(c) + k * series
        return norm_pdf(x) * k * series

    below = let(F.lit(1.0) / (1 + F.lit(CDF_SCALE) * F.abs(x)), tail)
    return F.when(x >= 0, 1 - below).otherwise(below)


def _d1(s, k, t, sigma, r, q):
    return (F.ln(s / k) + (r - q + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))


def price(kind: Column, s: Column, k: Column, t: Column, sigma: Column, r: float = RATE, q: float = 0.0) -> Column:
    carry, discount = F.exp(-q * t), F.exp(-r * t)

    def value(d: Column) -> Column:
        a, b = d["a"], d["a"] - d["v"]
        put = k * discount * norm_cdf(-b) - s * carry * norm_cdf(-a)
        call = s * carry * norm_cdf(a) - k * discount * norm_cdf(b)
        return F.when(kind == "put", put).otherwise(call)

    live = let(F.struct(_d1(s, k, t, sigma, r, q).alias("a"), (sigma * F.sqrt(t)).alias("v")), value)
    expired = F.greatest(F.lit(0.0), F.when(kind == "put", k - s).otherwise(s - k))
    return F.when((t <= 0) | (sigma <= 0), expired).otherwise(live)


def greeks(kind: Column, s: Column, k: Column, t: Column, sigma: Column, r: float = RATE, q: float = 0.0) -> dict:
    """delta, gamma, vega per vol point and theta per day; null when expired or without volatility."""
    a = _d1(s, k, t, sigma, r, q)
    root = F.sqrt(t)
    b = a - sigma * root
    carry, discount = F.exp(-q * t), F.exp(-r * t)
    decay = -(s * carry * norm_pdf(a) * sigma) / (2 * root)
    put_theta = decay - q * s * carry * norm_cdf(-a) + r * k * discount * norm_cdf(-b)
    call_theta = decay + q * s * carry * norm_cdf(a) - r * k * discount * norm_cdf(b)
    live = (t > 0) & (sigma > 0)
    return {
        "delta": F.when(live, F.when(kind == "put", carry * (norm_cdf(a) - 1)).otherwise(carry * norm_cdf(a))),
        "gamma": F.when(live, carry * norm_pdf(a) / (s * sigma * root)),
        "vega": F.when(live, s * carry * norm_pdf(a) * root / 100),
        "theta": F.when(live, F.when(kind == "put", put_theta).otherwise(call_theta) / 365),
    }


def implied_vol(kind: Column, s: Column, k: Column, t: Column, market: Column, r: float = RATE, q: float = 0.0,
                low: float = 1e-4, high: float = 5.0, steps: int = 100, tolerance: float = 1e-6) -> Column:
    """Volatility that reproduces a price, by bisection over whole Arrow batches; null when none can.
    Each step prices only the contracts whose bracket is still open."""

    @F.pandas_udf("double")
    def solve(kind: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, market: pd.Series) -> pd.Series:
        put = (kind == "put").to_numpy()
        spot, strike, years, paid = (x.to_numpy(float) for x in (s, k, t, market))
        with np.errstate(all="ignore"):
            parity = strike * np.exp(-r * years) - spot * np.exp(-q * years)
            floor = np.maximum(0.0, np.where(put, parity, -parity))
            top = prices(put, spot, strike, years, np.full(len(put), high), r, q)
            solvable = (paid > 0) & (years > 0) & (paid >= floor - 1e-6) & (top >= paid)
            lo, hi = np.full(len(put), low), np.full(len(put), high)
            at = np.flatnonzero(solvable)
            for _ in range(steps):
                if not len(at):
                    break
                mid = (lo[at] + hi[at]) / 2
                value = prices(put[at], spot[at], strike[at], years[at], mid, r, q)
                hit, above = np.abs(value - paid[at]) < tolerance, value > paid[at]
                lo[at] = np.where(above & ~hit, lo[at], mid)
                hi[at] = np.where(above | hit, mid, hi[at])
                at = at[lo[at] != hi[at]]
        return pd.Series(np.where(solvable, (lo + hi) / 2, np.nan))

    return solve(kind, *[c.cast("double") for c in (s, k, t, market)])


def prices(put: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, sigma: np.ndarray, r: float, q: float) -> np.ndarray:
    """`price` over arrays, for live contracts."""
    spread = sigma * np.sqrt(t)
    a = (np.log(s / k) + (r - q + sigma * sigma / 2) * t) / spread
    own, owed, sign = s * np.exp(-q * t), k * np.exp(-r * t), np.where(put, -1.0, 1.0)
    return sign * (own * cdf(sign * a) - owed * cdf(sign * (a - spread)))


def cdf(x: np.ndarray) -> np.ndarray:
    u = 1.0 / (1 + CDF_SCALE * np.abs(x))
    below = CDF_DENSITY * np.exp(-x * x / 2) * u * np.polyval(CDF_TERMS[::-1], u)
    return np.where(x >= 0, 1 - below, below)


def fairness(iv_to_realized: Column) -> Column:
    return (F.when(iv_to_realized.isNull(), "unknown").when(iv_to_realized < 0.95, "cheap")
            .when(iv_to_realized <= 1.35, "fair").otherwise("rich"))


def volatility_band(vix: Column) -> Column:
    return F.when(vix > 0, F.when(vix >= 22, "rich").when(vix <= 14, "cheap").otherwise("normal"))
