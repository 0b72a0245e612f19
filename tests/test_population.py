"""Sums of pieces against whole windows; shifts by Fourier transform; population gates against the gates of one family."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.catalog import gates as catalog
from tidebars.catalog.population import universe
from tidebars.operators import backtest as bt, ranges
from tidebars.operators.positions import _bar_images
from tidebars.operators.scan import number_rows
from tidebars.plans.families import REGISTRY, reading
from tidebars.plans.gates import oos, population, resample, stress, walkforward
from tidebars.session import materialize

SF = "/root/testdata/sf0.01"


def example(seed, n=200, count=7, scale=0.02):
    rng = np.random.default_rng(seed)
    executed = np.repeat(rng.integers(-1, 2, (n // 4 + 1, count)), 4, axis=0)[:n].astype(np.int8)
    executed[:, 0], executed[:, 1] = 0, 1
    market = rng.normal(0, scale, n)
    sides = np.abs(np.diff(executed, axis=0, prepend=np.zeros((1, count), np.int8)))
    return executed, executed * market[:, None], sides * 1e-4, sides * 5e-5, market


@pytest.mark.parametrize("seed", range(6))
def test_pieces_add_up(seed):
    executed, gross, spread, commission, _ = example(seed, scale=[0.02, 0.3][seed % 2])
    rng = np.random.default_rng(seed)
    cuts = [0, *sorted(rng.choice(np.arange(1, 200), 9, replace=False)), 200]
    parts = [ranges.summarize(executed[a:b], gross[a:b], spread[a:b], commission[a:b]) for a, b in zip(cuts, cuts[1:])]
    whole = ranges.finished(ranges.summarize(executed, gross, spread, commission))
    left = parts[0]
    for p in parts[1:]:
        left = ranges.combine(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = ranges.combine(p, right)
    for got in (left, right):
        assert np.allclose(ranges.finished(got), whole, rtol=1e-9, atol=1e-12)


def test_summary_is_what_bars_say():
    executed, gross, spread, commission, _ = example(3)
    s = ranges.finished(ranges.summarize(executed, gross, spread, commission))
    net = gross - spread - commission
    for k in range(executed.shape[1]):
        nav, e = np.cumprod(1 + net[:, k]), executed[:, k]
        begin = np.flatnonzero(np.diff(e, prepend=np.int8(9)))
        growth = [np.prod(1 + net[a:b, k]) - 1 for a, b in zip(begin, [*begin[1:], len(e)]) if e[a]]
        won = sorted((g for g in growth if g > 0), reverse=True)
        want = {"trades": len(growth), "profit": sum(won), "growth": nav[-1], "dip": (nav / np.maximum.accumulate(nav)).min(), "sq": (net[:, k] ** 2).sum(), "worst": net[:, k].min()}
        assert all(np.isclose(s[ranges.AT[n], k], v) for n, v in want.items())
        assert np.allclose(s[ranges._TOPS, k], (won + [0] * 5)[:5])


def test_images_are_those_of_the_bar_maps():
    assert [tuple(ranges.IMAGES[ord("a") + code]) for code in range(12)] == [_bar_images(code) for code in range(12)]


def test_shifts_by_fourier_transform():
    executed, gross, spread, commission, market = example(5, n=101)
    cost = spread + commission
    observed, null = population.null_sharpes(executed, market, cost, 252.0)
    for s in (1, 2, 50, 100):
        net = executed * np.roll(market, s)[:, None] - cost
        sd = net.std(axis=0, ddof=1)
        want = np.where(sd > 1e-12, net.mean(axis=0) / np.where(sd > 0, sd, 1) * np.sqrt(252.0), np.nan)
        assert np.allclose(null[s], want, equal_nan=True)
    assert np.allclose(observed, null[0], equal_nan=True)


def test_every_rule_reads_arrays():
    x = np.array([1.0, np.nan, -2.0])
    for name, spec in REGISTRY.items():
        if name != "trend_psar":
            with reading(lambda column: (x > 0 if column.startswith(("sqon", "sqoff")) else x).view(population.Values)):
                rule = spec.rule(spec.combinations()[0])
            assert all(np.asarray(v).shape == (3,) for v in vars(rule).values())


def test_rows_are_numbered_across_ranges(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 3 as int) as k").repartition(16)
    got = {r.id: r["rank"] for r in number_rows(df, [df.k.desc(), df.id.asc()]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 3), i)), start=1)}


@pytest.fixture(scope="module")
def tables(spark):
    series, bars = materialize(universe(spark, SF), "universe"), materialize(catalog.stored_daily(spark, SF, macro=True), "numbered")
    trials = spark.createDataFrame([(1137,)], "trials long")
    families = ["trend_sma", "mean_reversion_rsi", "volatility_squeeze"]
    return bars, trials, population.gate_tables(bars, None, series, trials, catalog.SPLIT, catalog.FOLDS, catalog.STRESS, resample.Resampling(500, 500), families)


def same(got, want, columns):
    got, want = (t.toPandas().set_index(["symbol", "params_key"]).sort_index() for t in (got, want))
    assert list(got.index) == list(want.index) and len(got)
    for c in columns:
        a, b = got[c], want[c]
        if a.dtype.kind in "fi" and b.dtype.kind in "fi":
            assert np.allclose(a.astype(float), b.astype(float), rtol=1e-6, atol=1e-8, equal_nan=True), c
        else:
            assert (a == b).all(), c


@pytest.mark.parametrize("family", ["trend_sma", "mean_reversion_rsi"])
def test_gates_equal_those_of_one_family(tables, family):
    bars, _, (l1, l2, _, _) = tables
    parents = REGISTRY[family].combinations()
    same(l1.where(F.col("family") == family), oos.gate(bars, family, parents, catalog.SPLIT), ["layer1_pass", "failure_reason", "net_sharpe", "net_total_return", "trade_count", "top_5_trade_profit_share", "median_neighbor_sharpe", "positive_neighbor_count"])
    same(l2.where(F.col("family") == family), walkforward.gate(bars, family, parents, catalog.FOLDS), ["layer2_pass", "failure_reason", "walkforward_net_sharpe", "walkforward_net_total_return", "total_test_trades", "selected_by_fold", "walkforward_total_transaction_cost"])


def test_stress_and_resampling_equal_those_of_one_family(tables):
    from tidebars.operators.positions import named, positions

    bars, trials, (_, _, l3, l4) = tables
    plan = [("trend_sma", p) for p in REGISTRY["trend_sma"].combinations()]
    book = materialize(bt.ledger(positions(bars, plan)), "book")
    want = stress.judge(stress.stress_metrics(book, stress.stress_windows(bars, catalog.STRESS)), stress.synthetic(book, catalog.STRESS), bars, catalog.STRESS)
    own = F.col("family") == "trend_sma"
    same(l3.where(own), named(want, plan), ["layer3_pass", "failure_reason", "fixed_net_return", "worst_historical_net_return", "synthetic_net_total_return", "synthetic_terminal_nav"])
    rows = named(book, plan)
    want4 = resample.permutation_test(rows, bars, 500).join(resample.deflated_sharpe(resample.moments(rows), trials), ["family", "symbol", "params_key"])
    same(l4.where(own), want4, ["observed_net_sharpe", "permutation_p_value", "permutation_sharpe_p95", "dsr_probability", "dsr_skewness", "dsr_kurtosis"])


def test_every_candidate_has_a_row_in_every_gate(tables):
    _, _, found = tables
    n = 3 * sum(len(REGISTRY[f].combinations()) for f in ("trend_sma", "mean_reversion_rsi", "volatility_squeeze"))
    assert [t.select("candidate_id").distinct().count() for t in found] == [n] * 4


def test_recursions_in_lanes_equal_windows(spark):
    """Exponential means of exponential means, blocks with halos, missing values before the seed."""
    from tidebars.functions import indicators as ind
    from tidebars.operators.panel import make_panel

    bars = spark.range(3000).selectExpr("cast(id % 2 as string) symbol", "cast(id div 2 as int) bar_no", "50 + 10 * sin(id / 40) + pmod(hash(id), 100) / 50 close")
    rows = []
    for in_lanes in (False, True):
        p = make_panel(bars, ("symbol",), 2 * ind.ema_halo(8) + 1, 700, in_lanes)
        p = ind.ema(ind.returns(ind.macd(ind.macd(p, 3, 8, 4), 3, 6, 5)), "ret1", 7, "rema_7", seed=1)
        rows.append(p.settle().orderBy("symbol", "bar_no").select("symbol", "bar_no", "ema_3", "macd_3_8", "macdsig_3_8_4", "macdsig_3_6_5", "rema_7").toPandas())
    windows, lanes = rows
    assert len(lanes) == 3000 and (windows[["symbol", "bar_no"]] == lanes[["symbol", "bar_no"]]).all(axis=None)
    for c in windows.columns[2:]:
        assert np.allclose(windows[c], lanes[c], rtol=1e-9, atol=1e-12, equal_nan=True), c
