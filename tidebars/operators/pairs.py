"""Pair spreads, pair pseudo-instruments and the cointegration screen."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

MIN_OVERLAP = 100
# Fixed value: share of explained variance from which legs count as collinear.
COLLINEAR = 1 - 100 * math.sqrt(2.220446049250313e-16)


def aligned_pairs(bars: DataFrame) -> DataFrame:
    """Every unordered pair of instruments on the timestamps both have.

    Joined on ``ts``, so the work is the overlap itself; instruments are a dimension.
    """
    a = bars.select("ts", F.col("symbol").alias("a"), F.col("close").alias("leg_a_close"), F.col("fill_spread_fraction").alias("spread_a"))
    b = bars.select("ts", F.col("symbol").alias("b"), F.col("close").alias("leg_b_close"), F.col("fill_spread_fraction").alias("spread_b"))
    return (
        a.join(b, "ts")
        .filter((F.col("a") < F.col("b")) & F.col("leg_a_close").isNotNull() & F.col("leg_b_close").isNotNull())
        .withColumn("symbol", F.concat_ws("_", "a", "b"))
        .drop("a", "b")
    )


def pair_spread(pairs: DataFrame) -> DataFrame:
    """Residual of leg A regressed on leg B over the whole overlap, with its hedge ratio."""
    w = Window.partitionBy("symbol")
    a, b = F.col("leg_a_close"), F.col("leg_b_close")
    return pairs.withColumns(
        {"hedge_ratio": F.regr_slope(a, b).over(w), "intercept": F.regr_intercept(a, b).over(w)}
    ).withColumn("spread", a - F.col("intercept") - F.col("hedge_ratio") * b)


def pair_bars(bars: DataFrame) -> DataFrame:
    """Tradable pseudo-bars: the spread lifted above zero, costs of both legs combined."""
    w = Window.partitionBy("symbol")
    s = pair_spread(aligned_pairs(bars))
    price = F.col("spread") - F.min("spread").over(w) + F.stddev_samp("spread").over(w)
    cost = F.col("spread_a") + F.abs("hedge_ratio") * F.col("spread_b")
    return s.withColumns({"price": price, "fill_spread_fraction": cost}).select(
        "symbol",
        "ts",
        *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        "fill_spread_fraction",
        "leg_a_close",
        "leg_b_close",
    )


# --- cointegration screen ------------------------------------------------------------
# Response-surface coefficients for the Engle-Granger t statistic with two
# series and a constant (MacKinnon 1994), lowest order first.
P_SMALL = (2.92, 1.5012, 0.039796)
P_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)
P_SWITCH, P_LOWEST, P_HIGHEST = -2.62, -18.86, 0.92


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def cointegration_p_value(stat: float) -> float:
    if stat > P_HIGHEST:
        return 1.0
    if stat < P_LOWEST:
        return 0.0
    coef = P_SMALL if stat <= P_SWITCH else P_LARGE
    return normal_cdf(sum(k * stat**i for i, k in enumerate(coef)))


def lag_order(n: int) -> int:
    """Largest lag tried for n residuals."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)


def solve_unit_root(gram: np.ndarray, n: int, lags: int) -> tuple[float, int]:
    """t statistic of the lagged level, with the lag count of least AIC.

    ``gram`` holds the cross products of (difference, level before it, earlier
    differences...), all over the same n rows.
    """

    def fit(k: int):
        x, y = gram[1 : 2 + k, 1 : 2 + k], gram[1 : 2 + k, 0]
        beta = np.linalg.solve(x, y)
        rss = max(gram[0, 0] - beta @ y, 1e-300)
        return beta, rss, x

    best, chosen = math.inf, 0
    for k in range(lags + 1):
        _, rss, _ = fit(k)
        aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * (k + 1)
        if aic < best:
            best, chosen = aic, k
    return best, chosen


def screen(bars: DataFrame, threshold: float = 0.05, chunk_rows: int = 20000) -> DataFrame:
    """Engle-Granger test of every pair with enough overlap.

    Rows are cut into chunks per pair; each chunk (with the tail it needs from its
    predecessor) yields one small cross-product matrix, and only those matrices meet.
    The lag is chosen on the common sample of the largest lag, then the statistic is
    taken on the longer sample that lag allows, which needs a second set of products.
    """
    w = Window.partitionBy("symbol")
    s = pair_spread(aligned_pairs(bars)).withColumns(
        {
            "n": F.count("*").over(w),
            "r2": F.regr_r2("leg_a_close", "leg_b_close").over(w),
            "i": F.row_number().over(w.orderBy("ts")) - 1,
        }
    ).filter(F.col("n") >= MIN_OVERLAP)
    halo = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 1) + 1
    own = F.floor(F.col("i") / chunk_rows)
    tail = F.pmod("i", F.lit(chunk_rows)) >= chunk_rows - halo
    chunks = s.select(
        "symbol", "n", "i", "spread", "r2", own.alias("own"),
        F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"),
    )

    def products(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = int(pdf["n"].iloc[0])
        top = lag_order(n)
        u, i = pdf["spread"].to_numpy(), pdf["i"].to_numpy()
        mine = pdf["own"].to_numpy() == key[1]
        if not mine.any() or len(u) < 2:
            return pd.DataFrame({"symbol": [], "n": [], "r2": [], "common": [], "ragged": []})
        d = np.diff(u, prepend=np.nan)
        cols = [d, np.concatenate([[np.nan], u[:-1]])]
        for k in range(1, top + 1):
            cols.append(np.concatenate([np.full(k, np.nan), d[:-k]])[: len(d)] if k < len(d) else np.full(len(d), np.nan))
        z = np.column_stack(cols)
        full = z[mine & (i >= top + 1)]
        ragged = np.zeros((top + 1, top + 2, top + 2))
        for k in range(top + 1):
            # Rows that lag k admits but the common sample does not.
            extra = z[mine & (i >= k + 1) & (i < top + 1)][:, : k + 2]
            ragged[k, : k + 2, : k + 2] = extra.T @ extra
        return pd.DataFrame(
            {"symbol": [key[0]], "n": [n], "r2": [pdf["r2"].iloc[0]], "common": [(full.T @ full).ravel()], "ragged": [ragged.ravel()]}
        )

    grams = chunks.groupBy("symbol", "chunk").applyInPandas(
        products, "symbol string, n long, r2 double, common array<double>, ragged array<double>"
    )

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        top = lag_order(n)
        if pdf["r2"].iloc[0] >= COLLINEAR:  # nothing is left of the spread: the legs move as one
            return pd.DataFrame({"symbol": [key[0]], "observations": [n], "lags": [0], "statistic": [-math.inf], "p_value": [0.0]})
        size = top + 2
        common = np.sum(np.vstack(pdf["common"].to_list()), axis=0).reshape(size, size)
        ragged = np.sum(np.vstack(pdf["ragged"].to_list()), axis=0).reshape(top + 1, size, size)
        _, lags = solve_unit_root(common, n - 1 - top, top)
        m = lags + 2
        gram = common[:m, :m] + ragged[lags, :m, :m]
        rows = n - 1 - lags
        x, y = gram[1:, 1:], gram[1:, 0]
        beta = np.linalg.solve(x, y)
        rss = gram[0, 0] - beta @ y
        sigma2 = rss / (rows - (lags + 1))
        stat = float(beta[0] / math.sqrt(sigma2 * np.linalg.inv(x)[0, 0]))
        return pd.DataFrame(
            {"symbol": [key[0]], "observations": [n], "lags": [lags], "statistic": [stat], "p_value": [cointegration_p_value(stat)]}
        )

    out = "symbol string, observations long, lags int, statistic double, p_value double"
    return grams.groupBy("symbol").applyInPandas(test, out).withColumn("cointegrated", F.col("p_value") < threshold)


def fixed_lag_statistic(bars: DataFrame) -> DataFrame:
    """Engle-Granger t statistic without lagged differences, in plain aggregates."""
    w = Window.partitionBy("symbol").orderBy("ts")
    s = pair_spread(aligned_pairs(bars)).withColumn("before", F.lag("spread").over(w))
    d, u = F.col("spread") - F.col("before"), F.col("before")
    g = s.filter(u.isNotNull()).groupBy("symbol").agg(
        F.count("*").alias("n"), F.sum(d * u).alias("du"), F.sum(u * u).alias("uu"), F.sum(d * d).alias("dd")
    )
    rho = F.col("du") / F.col("uu")
    sigma2 = (F.col("dd") - rho * F.col("du")) / (F.col("n") - 1)
    return g.filter(F.col("n") >= MIN_OVERLAP - 1).select(
        "symbol", "n", rho.alias("rho"), (rho / F.sqrt(sigma2 / F.col("uu"))).alias("statistic")
    )
