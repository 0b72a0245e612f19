import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import positions as pos
from tidebars.operators.candidates import near_params, valid
from tidebars.operators.positions import positions
from tidebars.plans.families import REGISTRY
from tidebars.plans.population import PANELS


def run(bars, wanted, **kw):
    out = positions(bars, wanted, **kw).select("symbol", "cand", "bar_no", "target", "executed", "before").toPandas()
    return out.sort_values(["symbol", "cand", "bar_no"]).reset_index(drop=True)


def test_registry_is_complete():
    assert len(REGISTRY) == 36
    assert sorted(f for group in PANELS for f in group) == sorted(REGISTRY)
    assert sum(len(s.combinations()) for s in REGISTRY.values()) == 414


@pytest.mark.parametrize("group", [PANELS[i : i + 3] for i in range(0, len(PANELS), 3)], ids=str)
def test_positions_are_complete_and_ternary(bars, group):
    wanted = [(f, c) for names in group for f in names for c in REGISTRY[f].combinations()[len(REGISTRY[f].combinations()) // 2 :][:1]]
    out = run(bars, wanted)
    assert len(out) == len(wanted) * bars.count()
    assert set(out["target"]) <= {-1, 0, 1}
    for _, g in out.groupby("cand"):
        assert (g["executed"].to_numpy()[1:] == g["target"].to_numpy()[:-1]).all()
        assert (g["before"].to_numpy()[1:] == g["executed"].to_numpy()[:-1]).all()
        assert g["executed"].iloc[0] == 0


def test_every_family_has_a_valid_neighbor():
    for name, spec in REGISTRY.items():
        combos = spec.combinations()
        assert near_params(name, combos[len(combos) // 2]), name


@pytest.mark.parametrize(
    "family, params",
    [
        ("trend", {"fast_window": 72, "slow_window": 72}),
        ("mean_reversion", {"lookback": 24, "entry_z": 1.0, "exit_z": 1.0}),
        ("mean_reversion_bollinger", {"window": 20, "num_std": 2.0, "entry_band": 0.54}),
        ("trend_psar", {"acceleration_step": 0.3, "acceleration_max": 0.2}),
        ("carry", {"threshold": -1}),
    ],
)
def test_domains_reject(family, params):
    assert not valid(REGISTRY[family], params)


def brute_held(z, entry, leave):
    state, out = 0, []
    for v in z:
        if not np.isfinite(v):
            state = 0
        elif state == 0:
            state = 1 if v <= -entry else -1 if v >= entry else 0
        elif state == 1 and v >= -leave:
            state = 0
        elif state == -1 and v <= leave:
            state = 0
        out.append(state)
    return np.array(out)


def test_held_rule_matches_sequential_loop_across_blocks(bars, ohlc, monkeypatch):
    monkeypatch.setattr(pos, "SCAN_ROWS", 37)
    params = {"lookback": 24, "entry_z": 1.5, "exit_z": 0.5}
    got = run(bars, [("mean_reversion", params)], block_rows=64)
    c = ohlc["close"]
    z = (c - c.rolling(24).mean()) / c.rolling(24).std(ddof=0)
    want = brute_held(z.to_numpy(), 1.5, 0.5)
    assert (got["target"].to_numpy() == want).all()
    assert (got["executed"].to_numpy() == np.concatenate([[0], want[:-1]])).all()
    assert (got["before"].to_numpy() == np.concatenate([[0, 0], want[:-2]])).all()


@pytest.mark.parametrize("family", ["mean_reversion_rsi", "trend_adx", "volatility_range_expansion", "momentum_acceleration", "stat_arb_rolling_hedge"])
def test_blocks_do_not_change_results(bars, family):
    wanted = [(family, p) for p in REGISTRY[family].combinations()[:2]]
    assert run(bars, wanted).equals(run(bars, wanted, block_rows=128))


def test_ema_matches_recursion(bars, ohlc):
    from tidebars.functions import indicators as ind
    from tidebars.operators.panel import make_panel

    for span in (2, 12, 48):
        p = ind.ema(make_panel(bars, ("symbol",), ind.ema_halo(span), block_rows=256), "close", span, "e")
        got = p.settle().orderBy("bar_no").toPandas()["e"].to_numpy()
        want = ohlc["close"].ewm(span=span, adjust=False, min_periods=span).mean().to_numpy()
        assert np.allclose(got[span - 1 :], want[span - 1 :], rtol=1e-12)
        assert np.isnan(got[: span - 1].astype(float)).all()


@pytest.mark.parametrize("family", ["stat_arb", "stat_arb_rsi", "stat_arb_return_zscore", "stat_arb_macd"])
def test_pair_rules_ignore_the_level_of_the_spread(bars, family):
    wanted = [(family, REGISTRY[family].combinations()[0])]
    moved = bars.withColumns({c: F.col(c) + 1000.0 for c in ("open", "high", "low", "close")})
    assert (run(bars, wanted)["target"] == run(moved, wanted)["target"]).mean() > 0.999


def test_constant_prices_give_no_zscore(spark, ohlc):
    from tidebars.operators.panel import number_bars

    flat = ohlc.assign(close=100.1)
    got = run(number_bars(spark.createDataFrame(flat)), [("mean_reversion", {"lookback": 24, "entry_z": 1.5, "exit_z": 0.0})])
    assert (got["target"] == 0).all()


def test_sar_blocks_match_one_pass(bars, ohlc):
    from tidebars.operators.sar import sar_codes

    params = [{"acceleration_step": 0.02, "acceleration_max": 0.2}, {"acceleration_step": 0.01, "acceleration_max": 0.1}]
    one = sar_codes(bars, ("symbol",), params).orderBy("bar_no").toPandas()["sar_codes"]
    cut = sar_codes(bars, ("symbol",), params, block_rows=100).orderBy("bar_no").toPandas()["sar_codes"]
    assert (one == cut).all()
    assert one.iloc[0] == "11" and set("".join(one.iloc[1:])) == {"0", "2"}
