"""Positions to returns, trades and metrics; whole-population backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import cte, dbl, query
from tidebars.catalog.population import universe
from tidebars.catalog.signals import FAMILY_QUERY, signal_ctes, stored_daily, stored_pairs
from tidebars.operators import backtest as bt
from tidebars.operators.positions import named, positions
from tidebars.plans.families import REGISTRY
from tidebars.plans.population import grid_backtest

CK = ("family", "symbol", "params_key")
CKEY = ", ".join(CK)

# --- SQL building blocks -------------------------------------------------------------


def ledger_sql(signals: str, base: str, keys: str = CKEY) -> str:
    """Executed positions, returns and costs of a signal table."""
    return f"""SELECT *, executed - before AS position_change, executed * r AS gross_return,
  abs(executed - before) * (fill_spread_fraction / 2) AS spread_cost, abs(executed - before) * 0.00005 AS commission_cost,
  abs(executed - before) * (fill_spread_fraction / 2) + abs(executed - before) * 0.00005 AS transaction_cost,
  executed * r - (abs(executed - before) * (fill_spread_fraction / 2) + abs(executed - before) * 0.00005) AS net_return
FROM (SELECT t.*, b.open, b.next_open, b.prev_ts, b.fill_spread_fraction, b.next_open / b.open - 1 AS r,
    coalesce(lag(t.target, 1) OVER x, 0) AS executed, coalesce(lag(t.target, 2) OVER x, 0) AS before
  FROM {signals} t JOIN {base} b ON b.symbol = t.symbol AND b.ts = t.ts WINDOW x AS (PARTITION BY {', '.join('t.' + k.strip() for k in keys.split(','))} ORDER BY t.ts))
WHERE next_open IS NOT NULL"""


def runs_sql(book: str, keys: str = CKEY, first: str = "prev_ts IS NULL") -> str:
    return f"SELECT *, sum(CASE WHEN ({first}) OR executed <> before THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts) AS trade_group FROM {book}"


def trades_sql(runs: str, keys: str = CKEY) -> str:
    return f"""SELECT {keys}, CAST(trade_group AS BIGINT) AS trade_group, min(ts) AS entry_timestamp, max(ts) AS exit_timestamp, CAST(max(executed) AS INTEGER) AS direction,
  arg_min(open, ts) AS entry_price, arg_max(next_open, ts) AS exit_price, (epoch(max(ts)) - epoch(min(ts))) / 3600 + 1.0 AS holding_hours,
  product(1 + gross_return) - 1 AS gross_trade_return, product(1 + net_return) - 1 AS net_trade_return, sum(transaction_cost) AS trade_cost
FROM {runs} WHERE executed <> 0 GROUP BY {keys}, trade_group"""


def nav_sql(book: str, keys: str = CKEY, returns: tuple[str, ...] = ("gross", "net")) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inner = ", ".join(f"product(1 + {r}_return) {w} AS {r}_nav" for r in returns)
    outer = ", ".join(f"{r}_nav / max({r}_nav) {w} - 1 AS {r}_drawdown" for r in returns)
    return f"SELECT *, {outer} FROM (SELECT *, {inner} FROM {book})"


def perf_sql(r: str, prefix: str, ppy: str = "ppy") -> list[str]:
    return [
        f"total_{r} AS {prefix}_total_return",
        f"CASE WHEN total_{r} > -1 AND {ppy} > 0 THEN power(1 + total_{r}, {ppy} / n) - 1 END AS {prefix}_annual_return",
        f"sd_{r} * sqrt({ppy}) AS {prefix}_annual_volatility",
        f"CASE WHEN sd_{r} > 1e-15 THEN mean_{r} / sd_{r} * sqrt({ppy}) END AS {prefix}_sharpe",
        f"dd_{r} AS {prefix}_max_drawdown",
        f"CASE WHEN dd_{r} < 0 AND total_{r} > -1 AND {ppy} > 0 THEN (power(1 + total_{r}, {ppy} / n) - 1) / abs(dd_{r}) END AS {prefix}_calmar",
    ]


PERF = ("total_return", "annual_return", "annual_volatility", "sharpe", "max_drawdown", "calmar")
ACTIVITY_D = (
    "periods_per_year", "total_trading_sides", "average_absolute_exposure", "long_exposure_fraction", "short_exposure_fraction",
    "flat_fraction", "total_transaction_cost", "total_spread_cost", "total_commission_cost", "cost_to_gross_profit_ratio",
    "trade_win_rate", "average_net_trade_return", "median_net_trade_return", "average_holding_hours", "maximum_holding_hours",
    "terminal_nav", "worst_bar_return",
)
ACTIVITY_I = ("observation_count", "trade_count", "position_change_count")


def metrics_sql(nav: str, trades: str, keys: str = CKEY, prefix: str = "", returns: tuple[str, ...] = ("gross", "net")) -> str:
    """Every metric of ``tidebars.operators.backtest.metrics`` from per-bar rows."""
    p = f"{prefix}_" if prefix else ""
    stats = ", ".join(
        f"product(1 + {r}_return) - 1 AS total_{r}, avg({r}_return) AS mean_{r}, stddev_samp({r}_return) AS sd_{r}, min({r}_drawdown) AS dd_{r}" for r in returns
    )
    last = returns[-1]
    perf = ", ".join(x for r in returns for x in perf_sql(r, f"{p}{r}"))
    using = keys
    return f"""SELECT {keys}, first_observation, last_observation, ppy AS {p}periods_per_year, CAST(n AS BIGINT) AS {p}observation_count,
  CAST(coalesce(tn, 0) AS BIGINT) AS {p}trade_count, CAST(changes AS BIGINT) AS {p}position_change_count, sides AS {p}total_trading_sides,
  (longs + shorts) / n AS {p}average_absolute_exposure, longs / n AS {p}long_exposure_fraction, shorts / n AS {p}short_exposure_fraction,
  flats / n AS {p}flat_fraction, cost AS {p}total_transaction_cost, scost AS {p}total_spread_cost, ccost AS {p}total_commission_cost, {perf},
  cost / (CASE WHEN profit > 0 THEN profit END) AS {p}cost_to_gross_profit_ratio, won AS {p}trade_win_rate, avg_t AS {p}average_net_trade_return,
  med_t AS {p}median_net_trade_return, avg_h AS {p}average_holding_hours, max_h AS {p}maximum_holding_hours,
  1 + total_{last} AS {p}terminal_nav, worst AS {p}worst_bar_return
FROM (SELECT *, CASE WHEN n >= 2 AND last_observation > first_observation THEN n / ((epoch(last_observation) - epoch(first_observation)) / 31557600.0) END AS ppy
  FROM (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, min(ts) AS first_observation, max(ts) AS last_observation, count_if(position_change <> 0) AS changes,
    CAST(sum(abs(position_change)) AS DOUBLE) AS sides, CAST(count_if(executed = 1) AS DOUBLE) AS longs, CAST(count_if(executed = -1) AS DOUBLE) AS shorts,
    CAST(count_if(executed = 0) AS DOUBLE) AS flats, sum(transaction_cost) AS cost, sum(spread_cost) AS scost, sum(commission_cost) AS ccost,
    sum(greatest(gross_return, 0)) AS profit, min({last}_return) AS worst, {stats}
  FROM {nav} GROUP BY {keys}))
LEFT JOIN (SELECT {keys}, count(*) AS tn, avg(CASE WHEN net_trade_return > 0 THEN 1.0 ELSE 0.0 END) AS won, avg(net_trade_return) AS avg_t,
    median(net_trade_return) AS med_t, avg(holding_hours) AS avg_h, max(holding_hours) AS max_h FROM {trades} GROUP BY {keys}) USING ({using})"""


def metric_columns(prefix: str = "", returns: tuple[str, ...] = ("gross", "net")) -> tuple[list[str], list[str]]:
    p = f"{prefix}_" if prefix else ""
    doubles = [f"{p}{c}" for c in ACTIVITY_D] + [f"{p}{r}_{c}" for r in returns for c in PERF]
    return doubles, [f"{p}{c}" for c in ACTIVITY_I]


def chain(prefix: str, signals: str, base: str) -> dict[str, str]:
    """Ledger, runs, trades, NAV and metrics tables named after ``prefix``."""
    return {
        f"{prefix}_bt": ledger_sql(signals, base),
        f"{prefix}_runs": runs_sql(f"{prefix}_bt"),
        f"{prefix}_trades": trades_sql(f"{prefix}_runs"),
        f"{prefix}_nav": nav_sql(f"{prefix}_bt"),
        f"{prefix}_met": metrics_sql(f"{prefix}_nav", f"{prefix}_trades"),
    }


# --- one family, step by step --------------------------------------------------------
SMA = {**signal_ctes("trend_sma"), **chain("sma", "sig_trend_sma_t", "daily_no")}


SMA_WANT = [("trend_sma", p) for p in REGISTRY["trend_sma"].combinations()]


def sma_book(spark, d):
    return bt.ledger(positions(stored_daily(spark, d), SMA_WANT))


def sma(df):
    return named(df, SMA_WANT)


@query("executed_positions", f"SELECT {CKEY}, ts, CAST(executed AS INTEGER) AS executed, CAST(position_change AS INTEGER) AS position_change, position_change <> 0 AS trade_executed FROM sma_bt", SMA)
def executed_positions(spark, d):
    return sma(sma_book(spark, d)).select(*CK, "ts", "executed", "position_change", (F.col("position_change") != 0).alias("trade_executed"))


COSTS = ("spread_cost", "commission_cost", "transaction_cost")


@query("transaction_costs", f"SELECT {CKEY}, ts, {dbl(*COSTS)} FROM sma_bt", SMA)
def transaction_costs(spark, d):
    return sma(sma_book(spark, d)).select(*CK, "ts", *COSTS)


@query("returns_net", f"SELECT {CKEY}, ts, round(r + 3.7e-8, 6) + 0.0 AS open_to_open_return, {dbl('gross_return', 'net_return')} FROM sma_bt", SMA)
def returns_net(spark, d):
    return sma(sma_book(spark, d)).select(*CK, "ts", "open_to_open_return", "gross_return", "net_return")


@query("nav_drawdown", f"SELECT {CKEY}, ts, {dbl('gross_nav', 'gross_drawdown', 'net_nav', 'net_drawdown')} FROM sma_nav", SMA)
def nav_drawdown(spark, d):
    return sma(bt.nav_and_drawdown(sma_book(spark, d))).select(*CK, "ts", "gross_nav", "gross_drawdown", "net_nav", "net_drawdown")


TRADE_D = ("entry_price", "exit_price", "holding_hours", "gross_trade_return", "net_trade_return", "trade_cost")


@query("trades", f"SELECT {CKEY}, trade_group, entry_timestamp, exit_timestamp, direction, {dbl(*TRADE_D)} FROM sma_trades", SMA)
def trades(spark, d):
    return sma(bt.trades(bt.runs(bt.segments(sma_book(spark, d))))).withColumn("trade_group", F.col("trade_group").cast("long"))


@query("periods_per_year", f"SELECT {CKEY}, {dbl('periods_per_year')} FROM sma_met", SMA)
def periods_per_year(spark, d):
    book = sma(sma_book(spark, d)).groupBy(*CK).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return book.select(*CK, bt.periods_per_year(F.col("n"), F.col("a"), F.col("b")).alias("periods_per_year"))


RETURN_METRICS = [f"{r}_{c}" for r in ("gross", "net") for c in PERF]


@query("return_metrics", f"SELECT {CKEY}, {dbl(*RETURN_METRICS)} FROM sma_met", SMA)
def return_metrics(spark, d):
    return sma(bt.metrics(bt.runs(bt.segments(sma_book(spark, d))))).select(*CK, *RETURN_METRICS)


ALL_D, ALL_I = metric_columns()
METRIC_SELECT = f"{CKEY}, first_observation, last_observation, {', '.join(ALL_I)}, {dbl(*ALL_D)}"


@query("candidate_metrics", f"SELECT {METRIC_SELECT} FROM mr_met", {**signal_ctes("mean_reversion"), **chain("mr", "sig_mr_zscore_t", "daily_no")})
def candidate_metrics(spark, d):
    return grid_backtest(stored_daily(spark, d), families=["mean_reversion"]).select(*CK, "first_observation", "last_observation", *ALL_I, *ALL_D)


# --- every family at once ------------------------------------------------------------
def population_ctes() -> dict[str, str]:
    out: dict[str, str] = {}
    parts: dict[str, list[str]] = {"daily_no": [], "pairs_no": []}
    for family, spec in REGISTRY.items():
        out |= signal_ctes(family)
        parts["pairs_no" if spec.universe == "pairs" else "daily_no"].append(f"{FAMILY_QUERY[family]}_t")
    for base, names in parts.items():
        tag = base[:1]
        union = " UNION ALL ".join(f"SELECT {CKEY}, ts, target FROM {n}" for n in names)
        out |= {f"pop{tag}_t": union, **chain(f"pop{tag}", f"pop{tag}_t", base)}
    return out


@query(
    "backtest_all",
    f"SELECT {METRIC_SELECT} FROM (SELECT * FROM popd_met UNION ALL SELECT * FROM popp_met) JOIN population_t USING ({CKEY})",
    population_ctes(),
)
def backtest_all(spark, d):
    single = stored_daily(spark, d, macro=True)
    pairs = stored_pairs(spark, d, single)
    return grid_backtest(single, pairs, universe=universe(spark, d, single)).select(*CK, "first_observation", "last_observation", *ALL_I, *ALL_D)
