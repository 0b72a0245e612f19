import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidebars.operators import backtest as bt
from tidebars.operators import pairs
from tidebars.operators.positions import named, positions
from tidebars.functions import normal
from tidebars.plans.gates import resample


def engle_granger(a, b):
    n = len(a)
    x = np.column_stack([np.ones(n), b])
    u = a - x @ np.linalg.lstsq(x, a, rcond=None)[0]
    top = pairs.lag_order(n)
    d = np.diff(u)

    def design(k, start):
        y = d[start:]
        cols = [u[start : n - 1]] + [d[start - j : n - 1 - j] for j in range(1, k + 1)]
        return y, np.column_stack(cols)

    def fit(y, z):
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        return beta, ((y - z @ beta) ** 2).sum()

    scores = []
    for k in range(top + 1):
        y, z = design(k, top)
        _, rss = fit(y, z)
        m = len(y)
        scores.append(m * (np.log(2 * np.pi) + np.log(rss / m) + 1) + 2 * (k + 1))
    k = int(np.argmin(scores))
    y, z = design(k, k)
    beta, rss = fit(y, z)
    se = np.sqrt(rss / (len(y) - k - 1) * np.linalg.inv(z.T @ z)[0, 0])
    return k, beta[0] / se


def test_cointegration_matches_direct_regression(spark, ohlc):
    a = ohlc[["symbol", "ts", "close", "fill_spread_fraction"]].assign(symbol="A")
    b = a.assign(symbol="B", close=ohlc["leg_b_close"])
    c = a.assign(symbol="C", close=100 + np.random.default_rng(1).normal(0, 1, len(a)).cumsum())
    rows = spark.createDataFrame(a).unionByName(spark.createDataFrame(b)).unionByName(spark.createDataFrame(c))
    series = {"A": a["close"].to_numpy(), "B": b["close"].to_numpy(), "C": c["close"].to_numpy()}
    for chunk in (20000, 200):
        got = pairs.screen(rows, chunk_rows=chunk).toPandas().set_index("symbol")
        assert set(got.index) == {"A_B", "A_C", "B_C"}
        for name, row in got.iterrows():
            x, y = name.split("_")
            lags, stat = engle_granger(series[x], series[y])
            assert row["lags"] == lags
            assert np.isclose(row["statistic"], stat, rtol=1e-6)
        assert got.loc["A_B", "cointegrated"]


def test_p_value_is_a_distribution():
    grid = np.linspace(-6, 0.9, 50)
    p = [pairs.cointegration_p_value(x) for x in grid]
    assert all(np.diff(p) > 0)
    assert abs(pairs.cointegration_p_value(-3.34) - 0.05) < 0.005


def test_permutation_matches_direct_shifts(spark, bars):
    plan = [("trend_sma", {"window": 120}), ("mean_reversion_rsi", {"window": 14, "entry_band": 15})]
    book = named(bt.ledger(positions(bars, plan)), plan).cache()
    got = resample.permutation_test(book, bars, 60).toPandas().set_index("family")
    rows = book.toPandas().sort_values(["family", "bar_no"])
    for family, g in rows.groupby("family"):
        n = len(g)
        label = "__".join([family, "X", g["params_key"].iloc[0]])
        years = (g["ts"].max() - g["ts"].min()).total_seconds() / (365.25 * 86400)
        r, pos, cost = g["open_to_open_return"].to_numpy(), g["executed"].to_numpy(), g["transaction_cost"].to_numpy()
        sharpe = lambda x: x.mean() / x.std(ddof=1) * np.sqrt(n / years)
        null = []
        for j in range(1, 61):
            s = 1 + int(hashlib.md5(f"{label}#shift#{j}".encode()).hexdigest()[:8], 16) % (n - 1)
            null.append(sharpe(pos * np.roll(r, s) - cost))
        seen = sharpe(g["net_return"].to_numpy())
        m = got.loc[family]
        assert np.isclose(m["observed_net_sharpe"], seen)
        assert np.isclose(m["permutation_mean_sharpe"], np.mean(null))
        assert np.isclose(m["permutation_sharpe_p95"], np.quantile(null, 0.95))
        assert np.isclose(m["permutation_p_value"], (1 + np.sum(np.array(null) >= seen)) / 61)


def test_draws_ignore_partitioning(spark):
    df = spark.range(1000).withColumn("d", resample.draw(F.lit("x"), F.col("id").cast("string")))
    a = {r.id: r.d for r in df.repartition(1).collect()}
    b = {r.id: r.d for r in df.repartition(13).collect()}
    assert a == b


def test_expected_maximum_grows_with_trials(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (1000.0,)], "t double")
    out = [r.e for r in df.select(F.expr(normal.expected_maximum("t")).alias("e")).collect()]
    assert out[0] == 0 and 1.5 < out[1] < 1.7 and 3.2 < out[2] < 3.3


def test_collinear_legs_are_cointegrated(spark):
    n, rng = 300, np.random.default_rng(3)
    b = 100 + np.cumsum(rng.normal(0, 1, n))
    rows = [(s, i, float(v), 0.0001) for s, leg in (("A", 2 * b + 5), ("B", b)) for i, v in enumerate(leg)]
    bars = spark.createDataFrame(rows, "symbol string, k long, close double, fill_spread_fraction double").withColumn("ts", F.timestamp_seconds(F.col("k") * 3600))
    r = pairs.screen(bars.drop("k")).first()
    assert (r.symbol, r.p_value, r.cointegrated, r.statistic) == ("A_B", 0.0, True, float("-inf"))
