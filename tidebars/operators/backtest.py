"""Positions to costed returns, drawdowns, trades and metrics.

Candidates are keyed by ``ckeys``. Bars arrive partitioned by (series, block), so the
ordered work is done inside a block and condensed to one row per position run
(*segment*); only segments are shuffled to their candidate. Drawdown, trades and every
metric are folded from segments, which makes the whole chain linear: no self-join, and
nothing larger than a candidate's list of trades meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

COMMISSION_BPS = 0.5
SECONDS_PER_YEAR = 365.25 * 86400
CANDIDATE = ("symbol", "cand")


def ledger(positions: DataFrame, commission_bps: float = COMMISSION_BPS) -> DataFrame:
    """Open-to-open returns net of half the spread and the commission per side traded.

    The last bar of a series has no next open and earns nothing; it is dropped. A bar whose
    spread is missing or negative stops the run: its cost cannot be computed.
    """
    spread = F.col("fill_spread_fraction")
    spread = F.when(spread >= 0, spread).otherwise(F.raise_error(F.lit("fill_spread_fraction is missing or negative")).cast("double"))
    sides = F.abs(F.col("executed") - F.col("before")).cast("double")
    return (
        positions.filter(F.col("next_open").isNotNull())
        .withColumn("open_to_open_return", F.col("next_open") / F.nullif(F.col("open"), F.lit(0.0)) - 1)
        .withColumns(
            {
                "position_change": F.col("executed") - F.col("before"),
                "gross_return": F.col("executed") * F.col("open_to_open_return"),
                "spread_cost": sides * (spread / 2),
                "commission_cost": sides * F.lit(commission_bps / 1e4),
            }
        )
        .withColumn("transaction_cost", F.col("spread_cost") + F.col("commission_cost"))
        .withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    )


def invalid_spreads(bars: DataFrame) -> DataFrame:
    """Bars whose cost cannot be computed: spread missing or negative."""
    return bars.filter(F.col("fill_spread_fraction").isNull() | (F.col("fill_spread_fraction") < 0))


def opens_run(start: Column | None = None) -> Column:
    """Whether a bar starts a new position run; the first bar of a window always does."""
    first = F.col("prev_ts").isNull() if start is None else F.col("prev_ts").isNull() | (F.col("prev_ts") < start)
    return first | (F.col("executed") != F.col("before"))


def segments(
    book: DataFrame,
    ckeys: tuple[str, ...] = CANDIDATE,
    series: tuple[str, ...] = ("symbol",),
    window_start: Column | None = None,
    returns: tuple[str, ...] = ("gross", "net"),
) -> DataFrame:
    """One row per position run and block, with everything later folds need.

    ``series`` are the keys the bars are already partitioned by (with ``blk``). A run is
    also cut where a bar loses 100 % or more, so that NAV keeps one sign inside a row.
    """
    key = list(dict.fromkeys([*series, "blk", *ckeys]))
    order = Window.partitionBy(*key).orderBy("bar_no")
    df = book.withColumn("opens", opens_run(window_start).cast("int"))
    ruin = F.lit(False)
    for r in returns:
        ruin = ruin | (F.col(f"{r}_return") <= -1)
    cut = F.greatest(F.col("opens"), ruin.cast("int"))
    df = df.withColumn("run", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = Window.partitionBy(*key, "run").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"nav_{r}": F.abs(F.product(1 + F.col(f"{r}_return")).over(local)) for r in returns})
    df = df.withColumns({f"top_{r}": F.max(f"nav_{r}").over(local) for r in returns})
    aggs = [
        F.min("bar_no").alias("b0"),
        F.max("opens").alias("opens"),
        F.max("executed").alias("direction"),
        F.min("ts").alias("t0"),
        F.max("ts").alias("t1"),
        F.min_by("open", "bar_no").alias("entry_price"),
        F.max_by("next_open", "bar_no").alias("exit_price"),
        F.count("*").alias("n"),
        F.count_if(F.col("position_change") != 0).alias("changes"),
        F.sum(F.abs("position_change")).cast("double").alias("sides"),
    ]
    aggs += [F.sum(c).alias(c) for c in ("transaction_cost", "spread_cost", "commission_cost")]
    aggs.append(F.sum(F.greatest(F.col("gross_return"), F.lit(0.0))).alias("profit"))
    for r in returns:
        x = F.col(f"{r}_return")
        aggs += [
            F.product(1 + x).alias(f"growth_{r}"),
            F.max(f"nav_{r}").alias(f"high_{r}"),
            F.min(f"nav_{r}").alias(f"low_{r}"),
            F.min(F.col(f"nav_{r}") / F.nullif(F.col(f"top_{r}"), F.lit(0.0))).alias(f"dip_{r}"),
            F.avg(x).alias(f"mean_{r}"),
            (F.var_pop(x) * F.count(x)).alias(f"m2_{r}"),
            F.min(x).alias(f"worst_{r}"),
        ]
    return df.groupBy(*key, "run").agg(*aggs)


def runs(segs: DataFrame, ckeys: tuple[str, ...] = CANDIDATE, returns: tuple[str, ...] = ("gross", "net")) -> DataFrame:
    """Whole position runs of each candidate (flat ones included), joined across blocks.

    Adds the lowest ratio of NAV to its running maximum seen in each run. While NAV is
    negative it cannot raise a positive maximum, so the deepest point is its largest size.
    """
    w = Window.partitionBy(*ckeys).orderBy("b0")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = segs.withColumns(
        {
            "trade_group": F.sum("opens").over(upto),
            **{f"base_{r}": F.coalesce(F.product(f"growth_{r}").over(before), F.lit(1.0)) for r in returns},
        }
    )
    size = {r: F.abs(f"base_{r}") for r in returns}
    below = {r: F.col(f"base_{r}") * F.col(f"growth_{r}") < 0 for r in returns}
    best = {r: F.when(below[r], -size[r] * F.col(f"low_{r}")).otherwise(size[r] * F.col(f"high_{r}")) for r in returns}
    df = df.withColumns({f"peak_{r}": F.max(best[r]).over(before) for r in returns})
    aggs = [
        F.min("t0").alias("entry_timestamp"),
        F.max("t1").alias("exit_timestamp"),
        F.max("direction").alias("direction"),
        F.min_by("entry_price", "b0").alias("entry_price"),
        F.max_by("exit_price", "b0").alias("exit_price"),
        F.sum("n").alias("n"),
        F.sum("changes").alias("changes"),
        F.sum("sides").alias("sides"),
        F.sum("transaction_cost").alias("trade_cost"),
        F.sum("spread_cost").alias("spread_cost"),
        F.sum("commission_cost").alias("commission_cost"),
        F.sum("profit").alias("profit"),
    ]
    for r in returns:
        peak = F.when(F.col(f"peak_{r}") > 0, F.col(f"peak_{r}"))
        under = F.coalesce(-size[r] * F.col(f"high_{r}") / peak, F.lit(1.0))
        lowest = F.when(below[r], under).otherwise(F.least(F.col(f"dip_{r}"), size[r] * F.col(f"low_{r}") / peak))
        aggs += [
            F.product(f"growth_{r}").alias(f"growth_{r}"),
            F.min(lowest).alias(f"dip_{r}"),
            F.sum(F.col("n") * F.col(f"mean_{r}")).alias(f"sum_{r}"),
            F.sum(F.col(f"m2_{r}") + F.col("n") * F.pow(F.col(f"mean_{r}"), F.lit(2))).alias(f"sq_{r}"),
            F.min(f"worst_{r}").alias(f"worst_{r}"),
        ]
    hours = (F.unix_timestamp("exit_timestamp") - F.unix_timestamp("entry_timestamp")) / 3600 + 1.0
    return df.groupBy(*ckeys, "trade_group").agg(*aggs).withColumn("holding_hours", hours.cast("double"))


def trades(run_table: DataFrame, ckeys: tuple[str, ...] = CANDIDATE) -> DataFrame:
    return run_table.filter(F.col("direction") != 0).select(
        *ckeys,
        "trade_group",
        "entry_timestamp",
        "exit_timestamp",
        "direction",
        "entry_price",
        "exit_price",
        "holding_hours",
        (F.col("growth_gross") - 1).alias("gross_trade_return"),
        (F.col("growth_net") - 1).alias("net_trade_return"),
        "trade_cost",
    )


def _performance(r: str, n: Column, ppy: Column, prefix: str) -> dict[str, Column]:
    """Annualised return statistics from the folded sums of return series ``r``."""
    total = F.col(f"growth_{r}") - 1
    mean = F.col(f"sum_{r}") / n
    var = F.when(n > 1, F.greatest((F.col(f"sq_{r}") - n * mean * mean) / (n - 1), F.lit(0.0)))
    std = F.sqrt(var)
    annual = F.when((total > -1) & (ppy > 0), F.pow(1 + total, ppy / n) - 1)
    drawdown = F.col(f"dip_{r}") - 1
    return {
        f"{prefix}_total_return": total,
        f"{prefix}_annual_return": annual,
        f"{prefix}_annual_volatility": std * F.sqrt(ppy),
        f"{prefix}_sharpe": F.when(std > 1e-15, mean / std * F.sqrt(ppy)),
        f"{prefix}_max_drawdown": drawdown,
        f"{prefix}_calmar": F.when(drawdown < 0, annual / F.abs(drawdown)),
    }


def periods_per_year(n: Column, first: Column, last: Column) -> Column:
    """Observations per calendar year; null for fewer than two or an empty span."""
    span = (F.unix_timestamp(last) - F.unix_timestamp(first)).cast("double")
    return F.when((n >= 2) & (span > 0), n / (span / SECONDS_PER_YEAR))


def metrics(
    run_table: DataFrame,
    ckeys: tuple[str, ...] = CANDIDATE,
    returns: tuple[str, ...] = ("gross", "net"),
    prefix: str = "",
) -> DataFrame:
    """Return, cost, exposure and trade statistics of each candidate (or window of it)."""
    traded = F.col("direction") != 0
    net_trade = F.when(traded, F.col(f"growth_{returns[-1]}") - 1)
    aggs = [
        F.sum("n").alias("n"),
        F.min("entry_timestamp").alias("first_observation"),
        F.max("exit_timestamp").alias("last_observation"),
        F.count_if(traded).alias("trade_count"),
        F.sum("changes").alias("position_change_count"),
        F.sum("sides").alias("total_trading_sides"),
        F.sum(F.when(F.col("direction") == 1, F.col("n")).otherwise(0)).alias("long_n"),
        F.sum(F.when(F.col("direction") == -1, F.col("n")).otherwise(0)).alias("short_n"),
        F.sum("trade_cost").alias("total_transaction_cost"),
        F.sum("spread_cost").alias("total_spread_cost"),
        F.sum("commission_cost").alias("total_commission_cost"),
        F.sum("profit").alias("profit"),
        F.avg((net_trade > 0).cast("double")).alias("trade_win_rate"),
        F.avg(net_trade).alias("average_net_trade_return"),
        F.median(net_trade).alias("median_net_trade_return"),
        F.avg(F.when(traded, F.col("holding_hours"))).alias("average_holding_hours"),
        F.max(F.when(traded, F.col("holding_hours"))).alias("maximum_holding_hours"),
    ]
    for r in returns:
        aggs += [
            F.product(f"growth_{r}").alias(f"growth_{r}"),
            F.min(f"dip_{r}").alias(f"dip_{r}"),
            F.sum(f"sum_{r}").alias(f"sum_{r}"),
            F.sum(f"sq_{r}").alias(f"sq_{r}"),
            F.min(f"worst_{r}").alias(f"worst_{r}"),
        ]
    n = F.col("n").cast("double")
    p = f"{prefix}_" if prefix else ""
    df = run_table.groupBy(*ckeys).agg(*aggs).withColumn(
        "ppy", periods_per_year(F.col("n"), F.col("first_observation"), F.col("last_observation"))
    )
    perf: dict[str, Column] = {}
    for r in returns:
        perf |= _performance(r, n, F.col("ppy"), f"{p}{r}")
    last = returns[-1]
    return df.select(
        *ckeys,
        "first_observation",
        "last_observation",
        F.col("ppy").alias(f"{p}periods_per_year"),
        F.col("n").alias(f"{p}observation_count"),
        F.col("trade_count").alias(f"{p}trade_count"),
        F.col("position_change_count").alias(f"{p}position_change_count"),
        F.col("total_trading_sides").alias(f"{p}total_trading_sides"),
        ((F.col("long_n") + F.col("short_n")) / n).alias(f"{p}average_absolute_exposure"),
        (F.col("long_n") / n).alias(f"{p}long_exposure_fraction"),
        (F.col("short_n") / n).alias(f"{p}short_exposure_fraction"),
        ((n - F.col("long_n") - F.col("short_n")) / n).alias(f"{p}flat_fraction"),
        F.col("total_transaction_cost").alias(f"{p}total_transaction_cost"),
        F.col("total_spread_cost").alias(f"{p}total_spread_cost"),
        F.col("total_commission_cost").alias(f"{p}total_commission_cost"),
        *[v.alias(k) for k, v in perf.items()],
        (F.col("total_transaction_cost") / F.when(F.col("profit") > 0, F.col("profit"))).alias(f"{p}cost_to_gross_profit_ratio"),
        F.col("trade_win_rate").alias(f"{p}trade_win_rate"),
        F.col("average_net_trade_return").alias(f"{p}average_net_trade_return"),
        F.col("median_net_trade_return").alias(f"{p}median_net_trade_return"),
        F.col("average_holding_hours").alias(f"{p}average_holding_hours"),
        F.col("maximum_holding_hours").alias(f"{p}maximum_holding_hours"),
        F.col(f"growth_{last}").alias(f"{p}terminal_nav"),
        F.col(f"worst_{last}").alias(f"{p}worst_bar_return"),
    )


def nav_and_drawdown(book: DataFrame, ckeys: tuple[str, ...] = CANDIDATE, series: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """NAV, running maximum and drawdown per bar. NAV starts at 1 + first return.

    Prefix products inside each block, then each block is lifted by the product and the
    running maximum of the blocks before it (one row per block).
    """
    key = list(dict.fromkeys([*series, "blk", *ckeys]))
    local = Window.partitionBy(*key).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    kinds = ("gross", "net")
    df = book.withColumns({f"_p_{r}": F.product(1 + F.col(f"{r}_return")).over(local) for r in kinds})
    df = df.withColumns({f"_m_{r}": F.max(f"_p_{r}").over(local) for r in kinds} | {f"_n_{r}": F.min(f"_p_{r}").over(local) for r in kinds})
    block = df.groupBy(*key).agg(
        *[F.max_by(f"_p_{r}", "bar_no").alias(f"_g_{r}") for r in kinds],
        *[F.max(f"_p_{r}").alias(f"_h_{r}") for r in kinds],
        *[F.min(f"_p_{r}").alias(f"_l_{r}") for r in kinds],
    )
    over = Window.partitionBy(*ckeys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    lift = lambda b, high, low: F.when(F.col(b) >= 0, F.col(b) * F.col(high)).otherwise(F.col(b) * F.col(low))
    block = block.withColumns({f"_b_{r}": F.coalesce(F.product(f"_g_{r}").over(over), F.lit(1.0)) for r in kinds})
    block = block.withColumns({f"_t_{r}": F.max(lift(f"_b_{r}", f"_h_{r}", f"_l_{r}")).over(over) for r in kinds})
    lifts = block.select(*key, *[f"_b_{r}" for r in kinds], *[f"_t_{r}" for r in kinds])
    out = df.join(lifts, key)
    for r in kinds:
        nav = F.col(f"_p_{r}") * F.col(f"_b_{r}")
        top = F.greatest(lift(f"_b_{r}", f"_m_{r}", f"_n_{r}"), F.col(f"_t_{r}"))
        out = out.withColumns({f"{r}_nav": nav, f"{r}_drawdown": nav / F.nullif(top, F.lit(0.0)) - 1})
    return out.drop(*[f"_{x}_{r}" for x in "pmnbt" for r in kinds])
