"""Technical indicators as window expressions over a panel.

Each function returns the panel with the named column added (and any intermediate one,
prefixed by an underscore, shared between callers). ``seed`` is the index of a series'
first non-null bar where it is known at plan time; the "window is full" guard is then a
comparison with ``bar_no`` instead of a second windowed count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F, Window

from tidebars.operators.panel import Panel, Recursion


def num(value: float) -> str:
    """A parameter value as part of a column name or candidate id: whole numbers as they are, others with six significant digits."""
    text = str(int(value)) if float(value).is_integer() else f"{value:g}"
    return text.replace(".", "p").replace("-", "m")


def full(p: Panel, n: int, col: str | Column, agg: Column, seed: int | None) -> Column:
    """``agg`` over the last n bars where all n hold a value, else null."""
    w = p.rows(n)
    ready = F.col("bar_no") >= seed + n - 1 if seed is not None else F.count(col).over(w) == n
    return F.when(ready, agg.over(w))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def running(p: Panel, col: str) -> Panel:
    """Running sums of a column inside each block, from which any window follows.

    A rolling mean or deviation is then a difference of two running values: constant
    work per bar, whatever the window length and however many windows are asked for.
    Values are taken relative to the block's first one, so that little is cancelled, and
    changes of value are counted exactly, so that a constant window has deviation 0.
    """
    if p.has(f"_s_{col}"):
        return p
    whole = p.order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = p.order.rowsBetween(Window.unboundedPreceding, 0)
    p = p.add(**{f"_o_{col}": F.first(col, True).over(whole), f"_e_{col}": F.coalesce((F.col(col) != p.lag(col)).cast("int"), F.lit(0))})
    d = F.coalesce(F.col(col) - F.col(f"_o_{col}"), F.lit(0.0))
    return p.add(
        **{
            f"_s_{col}": F.sum(d).over(upto),
            f"_q_{col}": F.sum(d * d).over(upto),
            f"_n_{col}": F.count(col).over(upto),
            f"_c_{col}": F.sum(f"_e_{col}").over(upto),
        }
    )


def _within(p: Panel, name: str, n: int) -> Column:
    """Growth of a running column over the last n bars."""
    return F.col(name) - F.coalesce(p.lag(name, n), F.lit(0))


def _ready(p: Panel, col: str, n: int, seed: int | None) -> Column:
    return F.col("bar_no") >= seed + n - 1 if seed is not None else _within(p, f"_n_{col}", n) == n


def _moments(p: Panel, col: str, n: int, seed: int | None) -> tuple[Column, Column]:
    """Rolling mean and population deviation of a column with running sums."""
    shift = _within(p, f"_s_{col}", n) / n
    var = _within(p, f"_q_{col}", n) / n - shift * shift
    moves = _within(p, f"_c_{col}", n - 1)
    std = F.when(moves == 0, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    ready = _ready(p, col, n, seed)
    return F.when(ready, F.col(f"_o_{col}") + shift), F.when(ready, std)


def sma(p: Panel, col: str, n: int, name: str, seed: int | None = 0) -> Panel:
    if p.has(name):
        return p
    p = running(p, col)
    return p.add(**{name: _moments(p, col, n, seed)[0]})


def deviation(p: Panel, col: str, n: int, name: str, seed: int | None = 0) -> Panel:
    """Population standard deviation over n bars."""
    if p.has(name):
        return p
    p = running(p, col)
    return p.add(**{name: _moments(p, col, n, seed)[1]})


def zscore(p: Panel, col: str, n: int, name: str, seed: int | None = 0) -> Panel:
    if p.has(name):
        return p
    p = running(p, col)
    mean, std = _moments(p, col, n, seed)
    return p.add(**{name: (F.col(col) - mean) / positive(std)})


def rolling_sum(p: Panel, col: str, n: int, name: str, seed: int | None = 0) -> Panel:
    if p.has(name):
        return p
    p = running(p, col)
    total = _within(p, f"_s_{col}", n) + n * F.col(f"_o_{col}")
    return p.add(**{name: F.when(_ready(p, col, n, seed), total)})


def change(p: Panel, col: str, k: int, name: str) -> Panel:
    return p.add(**{name: F.col(col) - p.lag(col, k)})


def ratio_change(p: Panel, col: str, k: int, name: str) -> Panel:
    base = p.lag(col, k)
    return p.add(**{name: F.col(col) / F.when(base != 0, base) - 1})


def returns(p: Panel) -> Panel:
    if p.has("ret1"):
        return p
    return ratio_change(p, "close", 1, "ret1")


def ema_chunk(span: int) -> int:
    """Bars after which a weight of this span has decayed below exp(-40)."""
    return math.ceil(40 / -math.log(1 - 2 / (span + 1)))


def ema_halo(span: int) -> int:
    return 2 * ema_chunk(span)


def ema(p: Panel, col: str, span: int, name: str, seed: int = 0) -> Panel:
    """Recursive exponential mean started at the seed bar, null before ``span`` values.

    The recursion e[t] = q*e[t-1] + a*x[t] is a prefix sum once each term is scaled by
    q**-p. Scaling restarts every ``ema_chunk`` bars to stay inside double range, and the
    chunk before it is carried in; anything older weighs less than exp(-40). A panel with lanes recurs bar by bar instead.
    """
    if p.has(name):
        return p
    alpha = 2 / (span + 1)
    if p.in_lanes:
        return p.add(**{name: Recursion(col, alpha, seed, seed + span - 1)})
    q = 1 - alpha
    size = ema_chunk(span)
    t = F.col("bar_no") - seed
    pos, chunk, local = f"_p_{name}", f"_k_{name}", f"_l_{name}"
    p = p.add(**{pos: F.pmod(t, F.lit(size)), chunk: F.floor(t / size)})
    term = F.when(t == 0, F.col(col)).when(t > 0, alpha * F.col(col)).otherwise(F.lit(0.0))
    within = (
        Window.partitionBy(*p.keys, "blk", chunk)
        .orderBy("bar_no")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    p = p.add(**{local: F.pow(F.lit(q), F.col(pos)) * F.sum(term * F.pow(F.lit(q), -F.col(pos))).over(within)})
    ends = F.when((F.col(pos) == size - 1) & (t >= 0), F.col(local))
    carried = F.last(ends, True).over(p.order.rowsBetween(Window.unboundedPreceding, -1))
    value = F.col(local) + F.coalesce(F.pow(F.lit(q), F.col(pos) + 1) * carried, F.lit(0.0))
    return p.add(**{name: F.when(t >= span - 1, value)})


def true_range(p: Panel) -> Panel:
    if p.has("tr"):
        return p
    before = p.lag("close")
    return p.add(
        tr=F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
        )
    )


def atr(p: Panel, n: int) -> Panel:
    if p.has(f"atr_{n}"):
        return p
    return sma(true_range(p), "tr", n, f"atr_{n}")


def bollinger(p: Panel, n: int) -> Panel:
    """Rolling mean and deviation; bands are mean +/- k deviations."""
    return deviation(sma(p, "close", n, f"sma_{n}"), "close", n, f"sd_{n}")


def close_ema(p: Panel, span: int) -> Panel:
    return ema(p, "close", span, f"ema_{span}")


def macd(p: Panel, fast: int, slow: int, signal: int) -> Panel:
    if p.has(f"macdsig_{fast}_{slow}_{signal}"):
        return p
    p = close_ema(close_ema(p, fast), slow)
    line = f"macd_{fast}_{slow}"
    p = p.add(**{line: F.col(f"ema_{fast}") - F.col(f"ema_{slow}")})
    return ema(p, line, signal, f"macdsig_{fast}_{slow}_{signal}", seed=max(fast, slow) - 1)


def vwap(p: Panel, n: int) -> Panel:
    if p.has(f"vwap_{n}"):
        return p
    p = p.add(_tpv=(F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    p = rolling_sum(rolling_sum(p, "volume", n, f"_vol_{n}"), "_tpv", n, f"_sum_{n}")
    return p.add(**{f"vwap_{n}": F.col(f"_sum_{n}") / positive(F.col(f"_vol_{n}"))})


def adx(p: Panel, n: int) -> Panel:
    """Directional indicators with simple means; on the first bar both moves count 0."""
    if p.has(f"adx_{n}"):
        return p
    up, down = F.col("high") - p.lag("high"), p.lag("low") - F.col("low")
    p = p.add(
        _pdm=F.when((up > down) & (up > 0), up).otherwise(0.0),
        _mdm=F.when((down > up) & (down > 0), down).otherwise(0.0),
    )
    p = sma(sma(atr(p, n), "_pdm", n, f"_spdm_{n}"), "_mdm", n, f"_smdm_{n}")
    tr = positive(F.col(f"atr_{n}"))
    p = p.add(**{f"pdi_{n}": 100 * F.col(f"_spdm_{n}") / tr, f"mdi_{n}": 100 * F.col(f"_smdm_{n}") / tr})
    a, b = F.col(f"pdi_{n}"), F.col(f"mdi_{n}")
    p = p.add(**{f"_dx_{n}": 100 * F.abs(a - b) / positive(a + b)})
    return sma(p, f"_dx_{n}", n, f"adx_{n}", seed=None)


def rsi(p: Panel, n: int) -> Panel:
    if p.has(f"rsi_{n}"):
        return p
    p = change(p, "close", 1, "diff1")
    d = F.col("diff1")
    p = p.add(
        _gain=F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
        _loss=F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
        _fell=F.when(d.isNotNull(), (d < 0).cast("double")),
    )
    p = sma(sma(p, "_gain", n, f"_ag_{n}", seed=1), "_loss", n, f"_al_{n}", seed=1)
    # Means are differences of running sums; whether a window has a loss at all is counted, and counts are exact.
    p = sma(p, "_fell", n, f"_fl_{n}", seed=1)
    loss = F.when(F.col(f"_fl_{n}") * n > 0.5, F.col(f"_al_{n}"))
    return p.add(**{f"rsi_{n}": 100 - 100 / (1 + F.col(f"_ag_{n}") / loss)})


def donchian(p: Panel, n: int) -> Panel:
    if p.has(f"mid_{n}"):
        return p
    high = full(p, n, "high", F.max("high"), 0)
    low = full(p, n, "low", F.min("low"), 0)
    return p.add(**{f"mid_{n}": (high + low) / 2})


def momentum(p: Panel, k: int) -> Panel:
    if p.has(f"mom_{k}"):
        return p
    return ratio_change(p, "close", k, f"mom_{k}")


def acceleration(p: Panel, k: int) -> Panel:
    if p.has(f"acc_{k}"):
        return p
    return change(momentum(p, k), f"mom_{k}", k, f"acc_{k}")


def return_deviation(p: Panel, n: int) -> Panel:
    return deviation(returns(p), "ret1", n, f"rvol_{n}", seed=1)


# Fixed value: hourly bars in a 252-day year of 24-hour sessions.
BARS_PER_YEAR = 24 * 252


def realized_vol(p: Panel, n: int) -> Panel:
    """Annualised deviation of one-bar returns, in percent."""
    if p.has(f"annvol_{n}"):
        return p
    p = return_deviation(p, n)
    return p.add(**{f"annvol_{n}": F.col(f"rvol_{n}") * math.sqrt(BARS_PER_YEAR) * 100})


def vol_zscore(p: Panel, n: int) -> Panel:
    if p.has(f"volz_{n}"):
        return p
    return zscore(return_deviation(p, n), f"rvol_{n}", 4 * n, f"volz_{n}", seed=n)


def leg_correlation(p: Panel, n: int) -> Panel:
    """Rolling correlation of the two legs' returns and its z-score over 4n bars."""
    if p.has(f"corrz_{n}"):
        return p
    p = ratio_change(ratio_change(p, "leg_a_close", 1, "_ra"), "leg_b_close", 1, "_rb")
    p = p.add(**{f"corr_{n}": full(p, n, "_ra", F.corr("_ra", "_rb"), 1)})
    return zscore(p, f"corr_{n}", 4 * n, f"corrz_{n}", seed=None)


def range_expansion(p: Panel, n: int) -> Panel:
    if p.has(f"avgrange_{n}"):
        return p
    p = p.add(_range=F.col("high") - F.col("low"))
    p = sma(p, "_range", n, f"_mrange_{n}")
    return p.add(**{f"avgrange_{n}": p.lag(f"_mrange_{n}")})


def squeeze(p: Panel, n: int, num_std: float, atr_multiple: float) -> Panel:
    """Band width against channel width; released on the first bar after a squeeze."""
    if p.has(f"sqoff_{n}_{num(num_std)}_{num(atr_multiple)}"):
        return p
    p = close_ema(atr(bollinger(p, n), n), n)
    on = f"sqon_{n}_{num(num_std)}_{num(atr_multiple)}"
    mean, mid = F.col(f"sma_{n}"), F.col(f"ema_{n}")
    half, side = num_std * F.col(f"sd_{n}"), atr_multiple * F.col(f"atr_{n}")
    narrow = ((mean + half) - (mean - half)) < ((mid + side) - (mid - side))
    p = p.add(**{on: F.coalesce(narrow, F.lit(False))})
    released = F.coalesce(p.lag(on), F.lit(False)) & ~F.col(on)
    return p.add(**{on.replace("sqon", "sqoff"): released})


def pct_b(p: Panel, n: int, num_std: float) -> Panel:
    if p.has(f"pctb_{n}_{num(num_std)}"):
        return p
    p = bollinger(p, n)
    mean, half = F.col(f"sma_{n}"), num_std * F.col(f"sd_{n}")
    width = positive((mean + half) - (mean - half))
    return p.add(**{f"pctb_{n}_{num(num_std)}": (F.col("close") - (mean - half)) / width - 0.5})


def vwap_zscore(p: Panel, n: int) -> Panel:
    """Distance from vwap in deviations of that distance; its mean is not removed."""
    if p.has(f"vwapz_{n}"):
        return p
    p = vwap(p, n)
    p = p.add(**{f"_vdev_{n}": F.col("close") - F.col(f"vwap_{n}")})
    p = deviation(p, f"_vdev_{n}", n, f"_vsd_{n}", seed=None)
    return p.add(**{f"vwapz_{n}": F.col(f"_vdev_{n}") / positive(F.col(f"_vsd_{n}"))})


def rolling_hedge(p: Panel, n: int) -> Panel:
    """Rolling hedge ratio (sample covariance over population variance) and its spread."""
    if p.has(f"rspread_{n}"):
        return p
    a, b = F.col("leg_a_close"), F.col("leg_b_close")
    ready = F.col("bar_no") >= n - 1
    w = p.rows(n)
    ratio = F.when(ready, F.covar_samp(a, b).over(w) / positive(F.var_pop(b).over(w)))
    p = p.add(**{f"hedge_{n}": ratio})
    hedge = F.col(f"hedge_{n}")
    intercept = F.avg(a).over(w) - hedge * F.avg(b).over(w)
    return p.add(**{f"rspread_{n}": F.when(ready, a - intercept - hedge * b)})


def rolling_hedge_zscore(p: Panel, n: int) -> Panel:
    if p.has(f"rhz_{n}"):
        return p
    return zscore(rolling_hedge(p, n), f"rspread_{n}", n, f"rhz_{n}", seed=None)
