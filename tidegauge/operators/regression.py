"""Ordinary least squares per group from sufficient statistics.

Means and centred cross products come from one aggregation (`covar_pop` merges stable partial
states), so a fit costs one shuffle of one row per group and partition, whatever the group's size.
The small normal equations are then solved in column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import change, ratio
from tidegauge.session import cut

SINGULAR = 1e-12
EXACT = 1e-12


def _inverse(s: list[list[Column]]) -> list[list[Column]]:
    """Inverse of a symmetric 1x1, 2x2 or 3x3 matrix of columns; null when singular."""
    k = len(s)
    if k == 1:
        det, adj = s[0][0], [[F.lit(1.0)]]
    elif k == 2:
        det = s[0][0] * s[1][1] - s[0][1] * s[1][0]
        adj = [[s[1][1], -s[0][1]], [-s[1][0], s[0][0]]]
    else:
        def minor(i, j):
            r = [x for x in range(3) if x != i]
            c = [x for x in range(3) if x != j]
            m = s[r[0]][c[0]] * s[r[1]][c[1]] - s[r[0]][c[1]] * s[r[1]][c[0]]
            return m if (i + j) % 2 == 0 else -m
        adj = [[minor(j, i) for j in range(3)] for i in range(3)]
        det = s[0][0] * minor(0, 0) + s[0][1] * minor(0, 1) + s[0][2] * minor(0, 2)
    diagonal = s[0][0]
    for i in range(1, k):
        diagonal = diagonal * s[i][i]
    safe = F.when(F.abs(det) > F.greatest(F.abs(diagonal) * SINGULAR, F.lit(1e-300)), det)
    return [[a / safe for a in row] for row in adj]


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Fit y on 1..3 columns with intercept. Returns coef_i, se_i, t_i (0 is the intercept), r2 and n
    per group; groups that are singular or too short are left out."""
    k = len(xs)
    rows = df.dropna(subset=[y, *xs])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy"),
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(x, y).alias(f"_c{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(xs[i], xs[j]).alias(f"_v{i}{j}") for i, j in pairs])
    n = F.col("n").cast("double")
    s = [[F.col(f"_v{min(i, j)}{max(i, j)}") * n for j in range(k)] for i in range(k)]
    inv = _inverse(s)
    solved = stats.where(F.col("n") > k + 2)
    for i in range(k):
        for j in range(i, k):
            solved = solved.withColumn(f"_i{i}{j}", inv[i][j])
    inv = [[F.col(f"_i{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
    for i in range(k):
        solved = solved.withColumn(f"coef_{i + 1}", sum(inv[i][j] * F.col(f"_c{j}") * n for j in range(k)))
    solved = solved.where(F.col("coef_1").isNotNull())
    fitted = sum(F.col(f"coef_{i + 1}") * F.col(f"_c{i}") * n for i in range(k))
    total = F.col("_vy") * n
    # an exact fit leaves only rounding noise, which must not turn into a t-statistic
    rest = total - fitted
    sse = F.when(rest > total * EXACT, rest).otherwise(0.0)
    sigma2 = sse / (n - (k + 1))
    spread = sum(F.col(f"_m{i}") * F.col(f"_m{j}") * inv[i][j] for i in range(k) for j in range(k))
    solved = (
        solved.withColumn("coef_0", F.col("_my") - sum(F.col(f"coef_{i + 1}") * F.col(f"_m{i}") for i in range(k)))
        .withColumn("se_0", F.sqrt(sigma2 * (1 / n + spread)))
        .withColumn("r2", F.when(total > 0, 1 - sse / total).otherwise(0.0))
    )
    for i in range(k):
        solved = solved.withColumn(f"se_{i + 1}", F.sqrt(F.greatest(sigma2 * inv[i][i], F.lit(0.0))))
    cols = []
    for i in range(k + 1):
        solved = solved.withColumn(f"t_{i}", F.coalesce(ratio(f"coef_{i}", f"se_{i}"), F.lit(0.0)))
        cols += [f"coef_{i}", f"se_{i}", f"t_{i}"]
    return solved.select(*keys, "n", *cols, "r2")


def level_returns(df: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Daily simple returns of several level columns that share their dates."""
    w = Window.partitionBy(*keys).orderBy("d")
    return df.select(*keys, "d", *[change(v, F.lag(v).over(w)).alias(v) for v in levels])


def factor_attribution(levels: DataFrame, keys: list[str], asset: str, factors: list[str],
                       min_dates: int = 81, t_stat: float = 2.0, freq: int = 252) -> DataFrame:
    """Annualised alpha with its t-statistic, betas and verdict per asset. `levels` holds the asset and
    factor levels on their common dates."""
    long_enough = levels.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_dates)
    rets = level_returns(levels.join(long_enough, keys, "left_semi"), keys, [asset, *factors])
    fit = ols(rets, keys, asset, factors)
    alpha = (F.abs("t_0") >= t_stat) & (F.col("coef_0") > 0)
    return fit.select(
        *keys, "n", (F.col("coef_0") * freq).alias("alpha_annual"), F.col("t_0").alias("alpha_t"),
        *[F.col(f"coef_{i + 1}").alias(f"beta_{f.lower()}") for i, f in enumerate(factors)], "r2",
        F.when(alpha, "alpha").otherwise("factor/beta").alias("verdict"))


def residual_loading(candidates: DataFrame, market: DataFrame, complex_: DataFrame, key: str = "grp",
                     beta_max: float = 0.3, min_dates: int = 60) -> DataFrame:
    """Loading of candidate returns (grp, d, ret) on the complex after taking the market out of it.

    The complex is regressed on the market first; its residual is the second factor. Only a positive
    loading above `beta_max` fails (a hedge passes).
    """
    factors = cut(market.select("d", F.col("ret").alias("m")).join(
        complex_.select("d", F.col("ret").alias("c")), "d"))
    stage1 = ols(factors.withColumn("_one", F.lit(1)), ["_one"], "c", ["m"]).where(F.col("n") >= min_dates)
    slope = stage1.select("coef_1").scalar()
    level = stage1.select("coef_0").scalar()
    residual = factors.withColumn("f", F.col("c") - (level + slope * F.col("m"))).select("d", "m", "f")
    joined = candidates.join(residual, "d")
    fit = ols(joined, [key], "ret", ["m", "f"]).where(F.col("n") >= min_dates)
    return fit.select(
        key, "n", F.col("coef_1").alias("market_beta"), F.col("coef_2").alias("residual_beta"),
        F.col("t_2").alias("residual_t"), "r2", (F.col("coef_2") <= beta_max).alias("qualifies"))


def axis_correlation(candidates: DataFrame, complex_: DataFrame, key: str = "grp", corr_max: float = 0.5,
                     beta_max: float = 0.7, min_dates: int = 60) -> DataFrame:
    """Correlation and beta of candidate returns to the complex, and whether both are small enough."""
    joined = candidates.join(complex_.select("d", F.col("ret").alias("c")), "d")
    fit = ols(joined, [key], "ret", ["c"]).where(F.col("n") >= min_dates)
    corr = F.signum("coef_1") * F.sqrt(F.greatest("r2", F.lit(0.0)))
    return fit.select(
        key, "n", corr.alias("corr"), F.col("coef_1").alias("beta"), "r2",
        ((F.abs(corr) < corr_max) & (F.abs("coef_1") < beta_max)).alias("qualifies"))
