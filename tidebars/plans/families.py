"""The 36 rule families: parameter grid, domain, indicators and rule of each.

A family states conditions as columns; how they become positions is the engine's
business (``tidebars.operators.positions``). A *level* rule gives a target straight from
the current bar. A *held* rule enters from flat, keeps the position until its exit
condition, never flips inside one bar, and is flat whenever its indicator is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import Column, functions as F

from tidebars.functions import indicators as ind
from tidebars.functions.indicators import num
from tidebars.operators.panel import Panel

Params = dict[str, float]


@dataclass(frozen=True)
class Level:
    long: Column
    short: Column


@dataclass(frozen=True)
class Held:
    available: Column
    enter_long: Column
    enter_short: Column
    exit_long: Column
    exit_short: Column


@dataclass(frozen=True)
class Family:
    name: str
    grid: dict[str, list[float]]
    domain: str  # SQL predicate over parameter names
    lookback: Callable[[Params], int]
    prepare: Callable[[Panel, Params], Panel]
    rule: Callable[[Params], Level | Held | str]
    needs: tuple[str, ...] = ()
    universe: str = "all"  # all | cash | pairs | real_volume
    integers: tuple[str, ...] = field(default=())

    def combinations(self) -> list[Params]:
        names = list(self.grid)
        return [dict(zip(names, values)) for values in product(*self.grid.values())]

    def candidate_key(self, params: Params) -> str:
        return "__".join(f"{k}-{num(v)}" for k, v in sorted(params.items()))


REGISTRY: dict[str, Family] = {}

# Parameters that must be whole numbers.
INTEGER_NAMES = (
    "window", "lookback", "fast_window", "slow_window", "fast_span", "slow_span", "signal_span",
    "span", "short_window", "realized_vol_window", "corr_window",
)


def _family(name, grid, domain, lookback, prepare, rule, needs=(), universe="all"):
    ints = tuple(k for k in grid if k in INTEGER_NAMES)
    REGISTRY[name] = Family(name, grid, domain, lookback, prepare, rule, needs, universe, ints)


def _above_below(x: Column, level: Column | float) -> Level:
    return Level(x > level, x < level)


def _beyond(x: Column, threshold: float) -> Level:
    return Level(x > threshold, x < -threshold)


def _revert(x: Column, entry: float, leave: float = 0.0) -> Held:
    """Enter against a stretched value, leave once it is back within ``leave``."""
    return Held(x.isNotNull(), x <= -entry, x >= entry, x >= -leave, x <= leave)


_source: ContextVar[Callable[[str], Any]] = ContextVar("source", default=F.col)


def c(name: str) -> Column:
    """What a rule reads: a column, or inside ``reading`` whatever stands for it there."""
    return _source.get()(name)


@contextmanager
def reading(source: Callable[[str], Any]) -> Iterator[None]:
    """Rules are only comparisons and arithmetic: within this block they read from ``source``, say arrays of a batch."""
    before = _source.set(source)
    try:
        yield
    finally:
        _source.reset(before)


# --- trend ---------------------------------------------------------------------------
_family(
    "trend",
    {"fast_window": [12, 24, 48], "slow_window": [72, 120, 240, 480]},
    "fast_window >= 2 AND slow_window >= 3 AND fast_window < slow_window",
    lambda p: ind.ema_halo(int(p["slow_window"])),
    lambda n, p: ind.close_ema(ind.close_ema(n, int(p["fast_window"])), int(p["slow_window"])),
    lambda p: _above_below(c(f"ema_{p['fast_window']:g}"), c(f"ema_{p['slow_window']:g}")),
)
_family(
    "trend_sma",
    {"window": [120, 240, 480]},
    "window >= 3",
    lambda p: p["window"],
    lambda n, p: ind.sma(n, "close", int(p["window"]), f"sma_{p['window']:g}"),
    lambda p: _above_below(c("close"), c(f"sma_{p['window']:g}")),
)
_family(
    "trend_donchian",
    {"window": [120, 240, 480]},
    "window >= 3",
    lambda p: p["window"],
    lambda n, p: ind.donchian(n, int(p["window"])),
    lambda p: _above_below(c("close"), c(f"mid_{p['window']:g}")),
)


def _macd_halo(p: Params) -> int:
    return ind.ema_halo(int(p["slow_span"])) + ind.ema_halo(int(p["signal_span"])) + 1


def _macd_prepare(n: Panel, p: Params) -> Panel:
    return ind.macd(n, int(p["fast_span"]), int(p["slow_span"]), int(p["signal_span"]))


def _macd_rule(p: Params) -> Level:
    line = f"{p['fast_span']:g}_{p['slow_span']:g}"
    return _above_below(c(f"macd_{line}"), c(f"macdsig_{line}_{p['signal_span']:g}"))


MACD_GRID = {"fast_span": [12, 24], "slow_span": [26, 52, 104], "signal_span": [9, 18]}
MACD_DOMAIN = "fast_span >= 2 AND slow_span >= 3 AND signal_span >= 2 AND fast_span < slow_span"
_family("trend_macd", MACD_GRID, MACD_DOMAIN, _macd_halo, _macd_prepare, _macd_rule)


def _adx_rule(p: Params) -> Level:
    n = f"{p['window']:g}"
    strong = c(f"adx_{n}") > p["adx_threshold"]
    up, down = c(f"pdi_{n}"), c(f"mdi_{n}")
    return Level(strong & (up > down), strong & (down > up))


_family(
    "trend_adx",
    {"window": [14, 24, 48], "adx_threshold": [20, 25, 30]},
    "window >= 3 AND adx_threshold > 0 AND adx_threshold <= 100",
    lambda p: 2 * p["window"] + 1,
    lambda n, p: ind.adx(n, int(p["window"])),
    _adx_rule,
)
_family(
    "trend_psar",
    {"acceleration_step": [0.01, 0.02, 0.03], "acceleration_max": [0.1, 0.2, 0.3]},
    "acceleration_step > 0 AND acceleration_step <= acceleration_max",
    lambda p: 1,
    lambda n, p: n,
    lambda p: "sar",
)

# --- mean reversion ------------------------------------------------------------------
ZSCORE_GRID = {"lookback": [24, 48, 96, 168], "entry_z": [1.5, 2.0, 2.5], "exit_z": [0.0, 0.5]}
ZSCORE_DOMAIN = "lookback >= 3 AND entry_z > 0 AND exit_z >= 0 AND exit_z < entry_z"
RSI_GRID = {"window": [14, 24, 48], "entry_band": [15, 20, 30]}
RSI_DOMAIN = "window >= 3 AND entry_band > 0 AND entry_band < 50"


def _close_z(n: Panel, p: Params) -> Panel:
    k = int(p["lookback"])
    return ind.zscore(n, "close", k, f"z_{k}")


def _rsi_rule(p: Params) -> Held:
    return _revert(c(f"rsi_{p['window']:g}") - 50, p["entry_band"])


_family(
    "mean_reversion", ZSCORE_GRID, ZSCORE_DOMAIN, lambda p: p["lookback"], _close_z,
    lambda p: _revert(c(f"z_{p['lookback']:g}"), p["entry_z"], p["exit_z"]),
)
_family(
    "mean_reversion_rsi", RSI_GRID, RSI_DOMAIN, lambda p: p["window"] + 1,
    lambda n, p: ind.rsi(n, int(p["window"])), _rsi_rule,
)
_family(
    "mean_reversion_return_zscore",
    {"lookback": [12, 24, 48], "entry_z": [1.5, 2.0]},
    "lookback >= 3 AND entry_z > 0",
    lambda p: p["lookback"] + 1,
    lambda n, p: ind.zscore(ind.returns(n), "ret1", int(p["lookback"]), f"rz_{p['lookback']:g}", seed=1),
    lambda p: _revert(c(f"rz_{p['lookback']:g}"), p["entry_z"]),
)
_family(
    "mean_reversion_bollinger",
    {"window": [20, 40, 80], "num_std": [1.5, 2.0, 2.5], "entry_band": [0.35, 0.4, 0.45]},
    "window >= 3 AND num_std > 0 AND entry_band > 0 AND entry_band < 0.5",
    lambda p: p["window"],
    lambda n, p: ind.pct_b(n, int(p["window"]), p["num_std"]),
    lambda p: _revert(c(f"pctb_{p['window']:g}_{num(p['num_std'])}"), p["entry_band"]),
)


def _keltner_rule(p: Params) -> Held:
    n = f"{p['window']:g}"
    mid, rng, close = c(f"ema_{n}"), c(f"atr_{n}"), c("close")
    return Held(
        mid.isNotNull(),
        close < mid - p["atr_multiple"] * rng,
        close > mid + p["atr_multiple"] * rng,
        close >= mid - p["exit_atr_multiple"] * rng,
        close <= mid + p["exit_atr_multiple"] * rng,
    )


_family(
    "mean_reversion_keltner",
    {"window": [20, 40, 80], "atr_multiple": [1.5, 2.0, 2.5], "exit_atr_multiple": [0.0, 0.5]},
    "window >= 3 AND atr_multiple > 0 AND exit_atr_multiple >= 0 AND exit_atr_multiple < atr_multiple",
    lambda p: ind.ema_halo(int(p["window"])),
    lambda n, p: ind.close_ema(ind.atr(n, int(p["window"])), int(p["window"])),
    _keltner_rule,
)
_family(
    "mean_reversion_vwap",
    {"lookback": [24, 48, 96], "entry_z": [1.5, 2.0]},
    "lookback >= 3 AND entry_z > 0",
    lambda p: 2 * p["lookback"],
    lambda n, p: ind.vwap_zscore(n, int(p["lookback"])),
    lambda p: _revert(c(f"vwapz_{p['lookback']:g}"), p["entry_z"]),
    needs=("volume",),
    universe="real_volume",
)

# --- momentum ------------------------------------------------------------------------
_family(
    "momentum",
    {"lookback": [24, 36, 48, 96, 168], "threshold": [0.0, 0.01, 0.02]},
    "lookback >= 2 AND threshold >= 0",
    lambda p: p["lookback"],
    lambda n, p: ind.momentum(n, int(p["lookback"])),
    lambda p: _beyond(c(f"mom_{p['lookback']:g}"), p["threshold"]),
)
_family(
    "momentum_ewma",
    {"span": [24, 96, 240], "threshold": [0.0, 0.0002]},
    "span >= 2 AND threshold >= 0",
    lambda p: ind.ema_halo(int(p["span"])) + 1,
    lambda n, p: ind.ema(ind.returns(n), "ret1", int(p["span"]), f"rema_{p['span']:g}", seed=1),
    lambda p: _beyond(c(f"rema_{p['span']:g}"), p["threshold"]),
)


def _risk_adjusted(n: Panel, p: Params) -> Panel:
    k = int(p["window"])
    if n.has(f"rar_{k}"):
        return n
    n = ind.sma(ind.return_deviation(n, k), "ret1", k, f"rmean_{k}", seed=1)
    return n.add(**{f"rar_{k}": c(f"rmean_{k}") / ind.positive(c(f"rvol_{k}"))})


_family(
    "momentum_risk_adjusted",
    {"window": [24, 96, 240], "threshold": [0.0, 0.05]},
    "window >= 3 AND threshold >= 0",
    lambda p: p["window"] + 1,
    _risk_adjusted,
    lambda p: _beyond(c(f"rar_{p['window']:g}"), p["threshold"]),
)


def _histogram(n: Panel, p: Params) -> Panel:
    n = _macd_prepare(n, p)
    line = f"{p['fast_span']:g}_{p['slow_span']:g}"
    name = f"hist_{line}_{p['signal_span']:g}"
    if n.has(name):
        return n
    n = n.add(**{name: (c(f"macd_{line}") - c(f"macdsig_{line}_{p['signal_span']:g}")) / F.when(c("close") != 0, c("close"))})
    return ind.change(n, name, 1, name.replace("hist", "hslope"))


def _histogram_rule(p: Params) -> Level:
    key = f"{p['fast_span']:g}_{p['slow_span']:g}_{p['signal_span']:g}"
    h, slope = c(f"hist_{key}"), c(f"hslope_{key}")
    return Level((h > 0) & (slope > p["threshold"]), (h < 0) & (slope < -p["threshold"]))


_family(
    "momentum_macd_histogram",
    {**MACD_GRID, "threshold": [0.0, 0.0005]},
    MACD_DOMAIN + " AND threshold >= 0",
    lambda p: _macd_halo(p) + 1,
    _histogram,
    _histogram_rule,
)


def _volume_prepare(n: Panel, p: Params) -> Panel:
    k = int(p["lookback"])
    return ind.sma(ind.momentum(n, k), "volume", k, f"avgvol_{k}")


def _volume_rule(p: Params) -> Level:
    k = f"{p['lookback']:g}"
    busy = c("volume") > p["volume_ratio"] * c(f"avgvol_{k}")
    move = _beyond(c(f"mom_{k}"), p["return_threshold"])
    return Level(busy & move.long, busy & move.short)


_family(
    "momentum_volume_confirmed",
    {"lookback": [24, 48, 96], "return_threshold": [0.0, 0.01, 0.02], "volume_ratio": [1.0, 1.5, 2.0]},
    "lookback >= 2 AND return_threshold >= 0 AND volume_ratio > 0",
    lambda p: p["lookback"],
    _volume_prepare,
    _volume_rule,
    needs=("volume",),
    universe="real_volume",
)
_family(
    "momentum_acceleration",
    {"lookback": [24, 48, 96], "threshold": [0.0, 0.005, 0.01]},
    "lookback >= 2 AND threshold >= 0",
    lambda p: 2 * p["lookback"],
    lambda n, p: ind.acceleration(n, int(p["lookback"])),
    lambda p: _beyond(c(f"acc_{p['lookback']:g}"), p["threshold"]),
)

# --- volatility ----------------------------------------------------------------------


def _breakout_rule(p: Params) -> Held:
    n, close = f"{p['window']:g}", c("close")
    mean, std = c(f"sma_{n}"), c(f"sd_{n}")
    return Held(
        mean.isNotNull(),
        close > mean + p["num_std"] * std,
        close < mean - p["num_std"] * std,
        close <= mean + p["exit_num_std"] * std,
        close >= mean - p["exit_num_std"] * std,
    )


_family(
    "volatility",
    {"window": [20, 40, 80], "num_std": [1.5, 2.0, 2.5, 3.0], "exit_num_std": [0.0, 0.5]},
    "window >= 3 AND num_std > 0 AND exit_num_std >= 0 AND exit_num_std < num_std",
    lambda p: p["window"],
    lambda n, p: ind.bollinger(n, int(p["window"])),
    _breakout_rule,
)


def _atr_rule(p: Params) -> Held:
    n, close = f"{p['window']:g}", c("close")
    mean, rng = c(f"sma_{n}"), c(f"atr_{n}")
    return Held(
        mean.isNotNull() & rng.isNotNull(),
        close > mean + p["num_atr"] * rng,
        close < mean - p["num_atr"] * rng,
        close <= mean,
        close >= mean,
    )


_family(
    "volatility_atr",
    {"window": [20, 40], "num_atr": [1.5, 2.0, 2.5]},
    "window >= 3 AND num_atr > 0",
    lambda p: p["window"] + 1,
    lambda n, p: ind.sma(ind.atr(n, int(p["window"])), "close", int(p["window"]), f"sma_{p['window']:g}"),
    _atr_rule,
)


def _range_rule(p: Params) -> Level:
    usual = c(f"avgrange_{p['window']:g}")
    wide = (usual > 0) & ((c("high") - c("low")) > p["expansion_multiple"] * usual)
    return Level(wide & (c("close") > c("open")), wide & (c("close") < c("open")))


_family(
    "volatility_range_expansion",
    {"window": [20, 40], "expansion_multiple": [1.5, 2.0]},
    "window >= 3 AND expansion_multiple >= 1",
    lambda p: p["window"] + 1,
    lambda n, p: ind.range_expansion(n, int(p["window"])),
    _range_rule,
)


def _premium_rule(p: Params) -> Level:
    premium = c("vix_level") - c(f"annvol_{p['realized_vol_window']:g}")
    return Level(premium < -p["threshold"], premium > p["threshold"])


_family(
    "volatility_vix_regime",
    {"realized_vol_window": [24, 48, 96], "threshold": [0.0, 5.0, 10.0]},
    "realized_vol_window >= 3 AND threshold >= 0",
    lambda p: p["realized_vol_window"] + 1,
    lambda n, p: ind.realized_vol(n, int(p["realized_vol_window"])),
    _premium_rule,
    needs=("vix_level",),
)


def _vol_mr_prepare(n: Panel, p: Params) -> Panel:
    k = int(p["short_window"])
    if n.has(f"drift_{k}"):
        return n
    n = ind.vol_zscore(n, k)
    return n.add(**{f"drift_{k}": F.col("close") - n.lag("close", k)})


def _vol_mr_rule(p: Params) -> Held:
    k = f"{p['short_window']:g}"
    z, drift = c(f"volz_{k}"), c(f"drift_{k}")
    return Held(
        z.isNotNull() & drift.isNotNull(),
        (z >= p["entry_z"]) & (drift < 0),
        (z >= p["entry_z"]) & (drift > 0),
        z <= p["exit_z"],
        z <= p["exit_z"],
    )


_family(
    "volatility_mean_reversion",
    {"short_window": [12, 24, 48], "entry_z": [1.5, 2.0], "exit_z": [0.0, 0.5]},
    "short_window >= 3 AND entry_z > 0 AND exit_z >= 0 AND exit_z < entry_z",
    lambda p: 5 * p["short_window"] + 1,
    _vol_mr_prepare,
    _vol_mr_rule,
)


def _squeeze_rule(p: Params) -> Held:
    key = f"{p['window']:g}_{num(p['num_std'])}_{num(p['atr_multiple'])}"
    on, off = c(f"sqon_{key}"), c(f"sqoff_{key}")
    return Held(
        c(f"sd_{p['window']:g}").isNotNull(),
        off & (c("close") > c("open")),
        off & (c("close") < c("open")),
        on,
        on,
    )


_family(
    "volatility_squeeze",
    {"window": [20, 40], "num_std": [1.5, 2.0], "atr_multiple": [1.5, 2.0]},
    "window >= 3 AND num_std > 0 AND atr_multiple > 0",
    lambda p: ind.ema_halo(int(p["window"])) + 1,
    lambda n, p: ind.squeeze(n, int(p["window"]), p["num_std"], p["atr_multiple"]),
    _squeeze_rule,
)

# --- pairs ---------------------------------------------------------------------------
_family(
    "stat_arb", ZSCORE_GRID, ZSCORE_DOMAIN, lambda p: p["lookback"], _close_z,
    lambda p: _revert(c(f"z_{p['lookback']:g}"), p["entry_z"], p["exit_z"]), universe="pairs",
)
_family(
    "stat_arb_rsi", RSI_GRID, RSI_DOMAIN, lambda p: p["window"] + 1,
    lambda n, p: ind.rsi(n, int(p["window"])), _rsi_rule, universe="pairs",
)
_family(
    "stat_arb_return_zscore",
    {"lookback": [12, 24, 48], "entry_z": [1.5, 2.0]},
    "lookback >= 3 AND entry_z > 0",
    lambda p: p["lookback"] + 1,
    lambda n, p: ind.zscore(ind.change(n, "close", 1, "diff1"), "diff1", int(p["lookback"]), f"dz_{p['lookback']:g}", seed=1),
    lambda p: _revert(c(f"dz_{p['lookback']:g}"), p["entry_z"]),
    universe="pairs",
)
_family("stat_arb_macd", MACD_GRID, MACD_DOMAIN, _macd_halo, _macd_prepare, _macd_rule, universe="pairs")
_family(
    "stat_arb_rolling_hedge", ZSCORE_GRID, ZSCORE_DOMAIN, lambda p: 2 * p["lookback"],
    lambda n, p: ind.rolling_hedge_zscore(n, int(p["lookback"])),
    lambda p: _revert(c(f"rhz_{p['lookback']:g}"), p["entry_z"], p["exit_z"]),
    needs=("leg_a_close", "leg_b_close"), universe="pairs",
)


def _corr_prepare(n: Panel, p: Params) -> Panel:
    k = int(p["corr_window"])
    return ind.sma(ind.leg_correlation(n, k), "close", k, f"sma_{k}")


def _corr_rule(p: Params) -> Held:
    k = f"{p['corr_window']:g}"
    z, mean, close = c(f"corrz_{k}"), c(f"sma_{k}"), c("close")
    broken, healed = z <= -p["entry_z"], z >= -p["exit_z"]
    return Held(z.isNotNull() & mean.isNotNull(), broken & (close < mean), broken & (close > mean), healed, healed)


_family(
    "stat_arb_correlation_breakdown",
    {"corr_window": [48, 96, 168], "entry_z": [1.5, 2.0], "exit_z": [0.0, 0.5]},
    "corr_window >= 3 AND entry_z > 0 AND exit_z >= 0 AND exit_z < entry_z",
    lambda p: 5 * p["corr_window"] + 1,
    _corr_prepare,
    _corr_rule,
    needs=("leg_a_close", "leg_b_close"),
    universe="pairs",
)

# --- carry ---------------------------------------------------------------------------
CARRY_GRID = {"threshold": [0.0, 0.25, 0.5, 0.75, 1.0]}


def _carry_level(name: str, column: str) -> None:
    _family(
        name, CARRY_GRID, "threshold >= 0", lambda p: 1, lambda n, p: n,
        lambda p: _beyond(c(column), p["threshold"]), needs=(column,), universe="cash",
    )


RATE = "interest_rate_differential"
_carry_level("carry", RATE)
_family(
    "carry_rate_momentum",
    {"lookback": [720, 1440, 2160], "threshold": [0.0, 0.25, 0.5]},
    "lookback >= 2 AND threshold >= 0",
    lambda p: p["lookback"],
    lambda n, p: ind.change(n, RATE, int(p["lookback"]), f"dmom_{p['lookback']:g}"),
    lambda p: _beyond(c(f"dmom_{p['lookback']:g}"), p["threshold"]),
    needs=(RATE,),
    universe="cash",
)
_family(
    "carry_zscore",
    {"lookback": [720, 1440, 2160], "entry_z": [1.0, 1.5]},
    "lookback >= 3 AND entry_z > 0",
    lambda p: p["lookback"],
    lambda n, p: ind.zscore(n, RATE, int(p["lookback"]), f"cz_{p['lookback']:g}", seed=None),
    lambda p: _revert(c(f"cz_{p['lookback']:g}"), p["entry_z"]),
    needs=(RATE,),
    universe="cash",
)
_carry_level("carry_real_rate", "real_rate_differential")
_carry_level("carry_term_slope", "term_slope_differential")


def _carry_risk(n: Panel, p: Params) -> Panel:
    k = int(p["window"])
    n = ind.return_deviation(n, k)
    return n.add(**{f"rac_{k}": c(RATE) / ind.positive(c(f"rvol_{k}"))})


_family(
    "carry_risk_adjusted",
    {"window": [24, 48, 96], "threshold": [0.0, 0.25, 0.5]},
    "window >= 3 AND threshold >= 0",
    lambda p: p["window"] + 1,
    _carry_risk,
    lambda p: _beyond(c(f"rac_{p['window']:g}"), p["threshold"]),
    needs=(RATE,),
    universe="cash",
)
