"""Rules of the gates on series that are too short, start late or have gaps; ids; quantiles of the normal distribution."""

from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebars.catalog import gates, signals
from tidebars.catalog.population import universe
from tidebars.functions import normal
from tidebars.functions.indicators import num
from tidebars.operators import asof, candidates
from tidebars.plans.families import REGISTRY
from tidebars.plans.gates import oos, population, resample, stress, walkforward
from tidebars.session import materialize
from tidebars.operators.panel import number_bars
from tidebars.sources import ticks


@pytest.fixture(scope="module")
def series(spark):
    """LONG covers seven years of days, SHORT the first eighty days of them."""
    frames = []
    for symbol, n in (("LONG", 2500), ("SHORT", 80)):
        days = pd.date_range("2015-01-01", periods=n, freq="D")
        price = [100 + (i * 7919 % 211) / 10 + i / 50 for i in range(n)]
        frames.append(pd.DataFrame({"symbol": symbol, "ts": days, "open": price, "high": [p + 1 for p in price], "low": [p - 1 for p in price], "close": [p + 0.5 for p in price], "volume": 1.0, "fill_spread_fraction": 0.0001}))
    return materialize(number_bars(spark.createDataFrame(pd.concat(frames))), "series")


def test_every_candidate_keeps_a_row(series):
    parents = REGISTRY["trend_sma"].combinations()
    split = oos.Split("2015-01-01 00:00:00", "2019-12-31 23:59:59", "2020-01-01 00:00:00")
    first = {(r.symbol, r.params_key): r for r in oos.gate(series, "trend_sma", parents, split).collect()}
    second = {(r.symbol, r.params_key): r for r in walkforward.gate(series, "trend_sma", parents).collect()}
    assert len(first) == len(second) == 2 * len(parents) and set(first) == set(second)
    for (symbol, _), r in first.items():
        assert (r.failure_reason == "no_oos_observations") == (symbol == "SHORT") and not (symbol == "SHORT" and r.layer1_pass)
    for (symbol, _), r in second.items():
        assert (r.failure_reason == "no_completed_folds") == (symbol == "SHORT") and not (symbol == "SHORT" and r.layer2_pass)


def test_stress_windows_are_all_needed(spark, series):
    """Fewer than three separated windows fail; a fixed window counts unless the series starts after it."""
    s = stress.Stress(fixed_start="2014-01-01 00:00:00", fixed_end="2014-01-31 23:59:59")
    windows = stress.stress_windows(series, s).groupBy("symbol").count().collect()
    found = {r["symbol"]: r["count"] for r in windows}
    assert found["LONG"] == 4 and found["SHORT"] < 4
    rows = [(x, 0, w, "worst_market_window", 0.0, -0.01) for x, n in (("LONG", 3), ("SHORT", 1)) for w in [f"worst_market_window_{i}" for i in range(n)]]
    hist = spark.createDataFrame(rows, "symbol string, cand int, stress_id string, stress_type string, net_total_return double, net_max_drawdown double")
    synth = spark.createDataFrame([("LONG", 0, 0.1, -0.1, 1.1), ("SHORT", 0, 0.1, -0.1, 1.1)], "symbol string, cand int, net_total_return double, net_max_drawdown double, terminal_nav double")
    out = {r.symbol: r for r in stress.judge(hist, synth, series, s).collect()}
    assert out["LONG"].layer3_pass and out["SHORT"].failure_reason == "missing_worst_market_windows"
    later = stress.Stress(fixed_start="2016-03-01 00:00:00", fixed_end="2016-03-31 23:59:59")
    out = {r.symbol: r for r in stress.judge(hist, synth, series, later).collect()}
    assert out["LONG"].failure_reason == "fixed_net_return;fixed_drawdown"


def test_gates_take_every_family_on_the_series_it_may_trade(spark, series):
    """trend_sma trades both series, momentum_volume_confirmed only the one with real volume; no candidate is lost."""
    rows = [("LONG", "single", "STK", "TRADES"), ("SHORT", "single", "CASH", "MIDPOINT")]
    universe = spark.createDataFrame(rows, "symbol string, kind string, sec_type string, what_to_show string")
    names = ["trend_sma", "momentum_volume_confirmed"]
    want = candidates.population(spark, universe).where(F.col("family").isin(names))
    trials = spark.createDataFrame([(100,)], "trials long")
    split = oos.Split("2015-01-01 00:00:00", "2019-12-31 23:59:59", "2020-01-01 00:00:00")
    tables = population.gate_tables(series, None, universe, trials, split, r=resample.Resampling(permutations=5, bootstraps=5), families=names)
    out = {r.candidate_id: r for r in population.funnel(want, tables).collect()}
    sizes = {f: len(REGISTRY[f].combinations()) for f in names}
    assert len(out) == want.count() == 2 * sizes["trend_sma"] + sizes["momentum_volume_confirmed"]
    assert {(r.family, r.symbol) for r in out.values()} == {("trend_sma", "LONG"), ("trend_sma", "SHORT"), ("momentum_volume_confirmed", "LONG")}
    for r in out.values():
        assert "no_gate_row" not in (r.layer1_failure, r.layer2_failure, r.layer3_failure, r.layer4_failure)
    alone = oos.gate(series, "trend_sma", REGISTRY["trend_sma"].combinations(), split).collect()
    assert all(out[f"trend_sma__{r.symbol}__{r.params_key}"].layer1_failure == r.failure_reason for r in alone)


@pytest.mark.parametrize("value", [0.25, 128.5714, 1234.56789, 0.00012345678, 0.000012345, 12.0, -0.5, 123456.75, 2.0000001, 99.9999999])
def test_ids_have_one_form(spark, value):
    got = spark.range(1).select(F.lit(value).cast("double").alias("v")).select(F.expr(candidates.format_value("v"))).first()[0]
    assert got == num(value)


def test_normal_distribution(spark):
    n = NormalDist()
    ps, xs = [1e-12, 1e-4, 0.05, 0.3, 0.5, 0.75, 0.999, 1 - 1e-9], [-9.0, -7.1, -2.0, -0.1, 0.0, 0.7, 3.0, 8.0]
    rows = spark.createDataFrame(list(zip(ps, xs)), "p double, x double").selectExpr("p", "x", f"{normal.quantile('p')} AS q", f"{normal.distribution('x')} AS d").collect()
    for r in rows:
        assert r.q == pytest.approx(n.inv_cdf(r.p), abs=1e-12) and r.d == pytest.approx(n.cdf(r.x), abs=1e-14)


@pytest.mark.parametrize("name", ["final_funnel", "deflated_probability", "l3_gate"])
def test_raw_tables_are_read_once(spark, monkeypatch, name):
    """All gates work on one stored table of bars, and bars are enriched from stored series."""
    read, enrich = [], asof.enrich
    raw = ticks.table
    monkeypatch.setattr(ticks, "table", lambda s, d, t: (read.append(t), raw(s, d, t))[1])

    def stored(bars, macro):
        assert not any(f"/{t}.parquet" in f for t in ("orders", "customer") for f in macro.inputFiles())
        return enrich(bars, macro)

    monkeypatch.setattr(asof, "enrich", stored)
    getattr(gates, name)(spark, "/root/testdata/sf0.001").collect()
    assert read.count("lineitem") == 1 and read.count("orders") <= 1 and "events" not in read


def test_universe_and_pairs_from_stored_bars(spark):
    sf = "/root/testdata/sf0.001"
    bars = materialize(signals.stored_daily(spark, sf, macro=True), "bars")
    for part in (universe, signals.stored_pairs):
        assert sorted(map(str, part(spark, sf, bars).collect())) == sorted(map(str, part(spark, sf).collect()))
