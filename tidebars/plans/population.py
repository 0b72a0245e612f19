"""Whole candidate populations through the backtest in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidebars.operators import backtest as bt
from tidebars.operators.candidates import tradable
from tidebars.operators.positions import named, positions
from tidebars.plans.families import REGISTRY, Params

# Families that share indicators (and a similar halo) share a panel; each indicator is
# computed once per series and window, whatever the number of candidates that read it.
PANELS = (
    ("trend", "mean_reversion_keltner", "volatility_squeeze"),
    ("trend_macd",),
    ("momentum_macd_histogram",),
    ("momentum_ewma", "momentum_risk_adjusted", "momentum", "momentum_acceleration"),
    ("momentum_volume_confirmed", "trend_sma", "trend_donchian", "trend_adx"),
    ("trend_psar",),
    ("mean_reversion", "mean_reversion_rsi", "mean_reversion_return_zscore"),
    ("mean_reversion_bollinger", "mean_reversion_vwap"),
    ("volatility", "volatility_atr", "volatility_range_expansion"),
    ("volatility_vix_regime", "volatility_mean_reversion", "carry_risk_adjusted"),
    ("carry", "carry_real_rate", "carry_term_slope", "carry_rate_momentum", "carry_zscore"),
    ("stat_arb", "stat_arb_rsi", "stat_arb_return_zscore"),
    ("stat_arb_macd",),
    ("stat_arb_rolling_hedge", "stat_arb_correlation_breakdown"),
)


def panel_groups(families: list[str] | None = None) -> list[list[tuple[str, Params]]]:
    groups = []
    for names in PANELS:
        for kind in sorted({REGISTRY[f].universe for f in names}):
            group = [(f, p) for f in names if REGISTRY[f].universe == kind and (families is None or f in families) for p in REGISTRY[f].combinations()]
            if group:
                groups.append(group)
    return groups


def grid_backtest(
    single: DataFrame | None,
    pairs: DataFrame | None = None,
    families: list[str] | None = None,
    commission_bps: float = bt.COMMISSION_BPS,
    universe: DataFrame | None = None,
) -> DataFrame:
    """Metrics of every family x grid point x series of numbered, stored bars.

    With ``universe`` (symbol, kind, sec_type, what_to_show) a family runs on the series it may trade only.
    """
    parts = []
    for group in panel_groups(families):
        kind = REGISTRY[group[0][0]].universe
        bars = pairs if kind == "pairs" else single
        if bars is not None:
            if universe is not None:
                bars = bars.join(universe.where(tradable(F.lit(kind))).select("symbol"), "symbol", "left_semi")
            book = bt.ledger(positions(bars, group), commission_bps)
            parts.append(named(bt.metrics(bt.runs(bt.segments(book))), group))
    return reduce(DataFrame.unionByName, parts)
