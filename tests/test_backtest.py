import numpy as np
import pandas as pd
import pytest

from tidebars.operators import backtest as bt
from tidebars.operators.panel import number_bars
from tidebars.operators.positions import positions


def brute(ohlc, target):
    executed = np.concatenate([[0], target[:-1]])
    before = np.concatenate([[0], executed[:-1]])
    d = pd.DataFrame({"ts": ohlc["ts"], "open": ohlc["open"], "executed": executed, "before": before, "spread": ohlc["fill_spread_fraction"]})
    d["r"] = d["open"].shift(-1) / d["open"] - 1
    d = d[d["r"].notna()].copy()
    d["cost"] = (d["executed"] - d["before"]).abs() * (d["spread"] / 2 + 0.00005)
    d["net"] = d["executed"] * d["r"] - d["cost"]
    nav = (1 + d["net"]).cumprod()
    group = (d["executed"] != d["executed"].shift()).cumsum()
    trades = d[d["executed"] != 0].groupby(group)["net"].apply(lambda x: (1 + x).prod() - 1)
    return d, nav, trades


@pytest.fixture(scope="module", params=[False, True], ids=["calm", "ruinous"])
def case(request, spark, ohlc):
    data = ohlc.copy()
    if request.param:
        # Bars that more than double or nearly vanish push short and long NAVs below zero.
        for i, factor in ((300, 2.6), (301, 0.4), (700, 2.4), (705, 0.5), (1100, 2.2)):
            data.loc[i:, ["open", "high", "low", "close"]] *= factor
    bars = number_bars(spark.createDataFrame(data))
    wanted = [("mean_reversion_rsi", {"window": 14, "entry_band": 15}), ("trend_sma", {"window": 120})]
    pos = positions(bars, wanted, block_rows=128).cache()
    return data, pos


def test_metrics_and_trades_match_pandas(case):
    data, pos = case
    runs = bt.runs(bt.segments(bt.ledger(pos)))
    metrics = bt.metrics(runs).toPandas().set_index("cand")
    found = bt.trades(runs).toPandas()
    rows = pos.toPandas().sort_values(["cand", "bar_no"])
    for cand, g in rows.groupby("cand"):
        d, nav, trades = brute(data, g["target"].to_numpy())
        m = metrics.loc[cand]
        assert m["observation_count"] == len(d)
        assert m["trade_count"] == len(trades)
        assert np.isclose(m["net_total_return"], nav.iloc[-1] - 1)
        assert np.isclose(m["net_max_drawdown"], (nav / nav.cummax() - 1).min())
        years = (d["ts"].iloc[-1] - d["ts"].iloc[0]).total_seconds() / (365.25 * 86400)
        assert np.isclose(m["net_sharpe"], d["net"].mean() / d["net"].std() * np.sqrt(len(d) / years))
        assert np.isclose(m["median_net_trade_return"], trades.median())
        assert np.isclose(m["total_transaction_cost"], d["cost"].sum())
        mine = found[found["cand"] == cand].sort_values("trade_group")["net_trade_return"].to_numpy()
        assert np.allclose(mine, trades.to_numpy())


def test_nav_and_drawdown_per_bar(case):
    data, pos = case
    got = bt.nav_and_drawdown(bt.ledger(pos)).toPandas().sort_values(["cand", "bar_no"])
    rows = pos.toPandas().sort_values(["cand", "bar_no"])
    for cand, g in rows.groupby("cand"):
        _, nav, _ = brute(data, g["target"].to_numpy())
        mine = got[got["cand"] == cand]
        assert np.allclose(mine["net_nav"], nav)
        assert np.allclose(mine["net_drawdown"], nav / nav.cummax() - 1)


def test_missing_spreads_are_reported(spark, ohlc):
    bad = ohlc.head(10).copy()
    bad.loc[3, "fill_spread_fraction"] = None
    bad.loc[4, "fill_spread_fraction"] = -0.1
    assert bt.invalid_spreads(spark.createDataFrame(bad)).count() >= 1
