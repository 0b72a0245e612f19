"""Gate 3: historical and synthetic stress."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window

from tidebars.operators import backtest as bt
from tidebars.plans.gates import failures


@dataclass(frozen=True)
class Stress:
    fixed_start: str = "2020-03-01 00:00:00"
    fixed_end: str = "2020-03-31 23:59:59"
    window_days: int = 30
    window_count: int = 3
    separation_days: int = 30
    return_multiplier: float = 1.5
    spread_multiplier: float = 2.0
    maximum_fixed_drawdown: float = 0.35
    minimum_fixed_return: float = -0.30
    maximum_worst_drawdown: float = 0.40
    minimum_worst_return: float = -0.30
    maximum_synthetic_drawdown: float = 0.45
    minimum_synthetic_return: float = -0.35
    minimum_synthetic_nav: float = 0.65


def daily_returns(bars: DataFrame) -> DataFrame:
    """Open-to-open returns of daily first opens; days without bars are skipped."""
    days = bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.min_by("open", "ts").alias("open"))
    w = Window.partitionBy("symbol").orderBy("day")
    before = F.lag("open").over(w)
    return days.withColumn("daily_return", F.col("open") / before - 1).filter(F.col("daily_return").isNotNull())


def rolling_compound(daily: DataFrame, n: int = 30) -> DataFrame:
    """Compounded return of the last n observations."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-(n - 1), 0)
    full = F.count("daily_return").over(w) == n
    return daily.withColumn("rolling_return", F.when(full, F.product(1 + F.col("daily_return")).over(w) - 1)).filter(
        F.col("rolling_return").isNotNull()
    )


def worst_windows(rolling: DataFrame, s: Stress = Stress()) -> DataFrame:
    """The lowest rolling returns, each clear of the ones chosen before it.

    One pass per chosen window over the symbol's days; all passes share a shuffle.
    """
    w = Window.partitionBy("symbol")
    far = (s.window_days - 1 + s.separation_days) * 86400
    df = rolling.select("symbol", F.unix_timestamp("day").alias("t"), F.col("rolling_return").alias("r"))
    free = F.lit(True)
    picks = []
    for i in range(s.window_count):
        df = df.withColumn(f"best{i}", F.min(F.when(free, F.struct("r", "t"))).over(w))
        chosen = F.col(f"best{i}.t")
        # Windows end at 23:59:59: clear before is strict in whole days, clear after too.
        clear = (F.col("t") < chosen - far) | (F.col("t") - (s.window_days - 1) * 86400 > chosen + 86399 + s.separation_days * 86400)
        free = free & clear
        picks.append(F.struct(F.lit(f"worst_market_window_{i + 1}").alias("stress_id"), F.col(f"best{i}").alias("b")))
    one = df.groupBy("symbol").agg(*[F.first(f"best{i}").alias(f"best{i}") for i in range(s.window_count)])
    rows = one.select("symbol", F.explode(F.array(*picks)).alias("p")).filter(F.col("p.b").isNotNull())
    t = F.col("p.b.t")
    return rows.select(
        "symbol",
        F.col("p.stress_id").alias("stress_id"),
        F.lit("worst_market_window").alias("stress_type"),
        F.timestamp_seconds(t - (s.window_days - 1) * 86400).alias("stress_start"),
        F.timestamp_seconds(t + 86399).alias("stress_end"),
        F.col("p.b.r").alias("market_return"),
    )


def stress_windows(bars: DataFrame, s: Stress = Stress()) -> DataFrame:
    """The fixed window and the worst ones of each series, ends inclusive."""
    worst = worst_windows(rolling_compound(daily_returns(bars), s.window_days), s)
    fixed = bars.select("symbol").distinct().select(
        "symbol",
        F.lit("fixed").alias("stress_id"),
        F.lit("fixed_historical").alias("stress_type"),
        F.lit(s.fixed_start).cast("timestamp").alias("stress_start"),
        F.lit(s.fixed_end).cast("timestamp").alias("stress_end"),
        F.lit(None).cast("double").alias("market_return"),
    )
    return fixed.unionByName(worst)


SKEYS = ("symbol", "cand", "stress_id")
METRICS = ("observation_count", "net_total_return", "net_annual_return", "net_annual_volatility", "net_sharpe", "net_max_drawdown", "terminal_nav", "worst_bar_return")


def _short(df: DataFrame) -> DataFrame:
    """Fewer than two observations give no metric but the count."""
    enough = F.col("observation_count") >= 2
    return df.withColumns({c: F.when(enough, F.col(c)) for c in METRICS if c != "observation_count"})


def stress_metrics(book: DataFrame, windows: DataFrame) -> DataFrame:
    """Metrics of each candidate inside each stress window of its series."""
    w = windows.select("symbol", "stress_id", "stress_type", "stress_start", "stress_end", "market_return")
    inside = book.join(w, "symbol").filter((F.col("ts") >= F.col("stress_start")) & (F.col("ts") <= F.col("stress_end")))
    keys = (*SKEYS, "stress_type", "market_return")
    segs = bt.segments(inside, keys, ("symbol",), F.col("stress_start"), ("net",))
    return _short(bt.metrics(bt.runs(segs, keys, ("net",)), keys, ("net",)))


def synthetic(book: DataFrame, s: Stress = Stress()) -> DataFrame:
    """Gross returns and spreads scaled up, commission unchanged, over the whole sample."""
    stressed = book.withColumns(
        {
            "gross_return": F.col("gross_return") * s.return_multiplier,
            "spread_cost": F.col("spread_cost") * s.spread_multiplier,
        }
    )
    stressed = stressed.withColumn("transaction_cost", F.col("spread_cost") + F.col("commission_cost"))
    stressed = stressed.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    return _short(bt.metrics(bt.runs(bt.segments(stressed, returns=("net",)), returns=("net",)), returns=("net",)))


def judge(historical: DataFrame, synth: DataFrame, bars: DataFrame, s: Stress = Stress()) -> DataFrame:
    """A fixed window that ends before a series starts does not count; one without bars fails, as do missing worst windows."""
    c = F.col
    fixed, worst = c("stress_id") == "fixed", c("stress_type") == "worst_market_window"
    per = historical.groupBy("symbol", "cand").agg(
        F.count_if(worst).alias("_worst"),
        F.max(F.when(fixed, c("net_total_return"))).alias("fixed_net_return"),
        F.max(F.when(fixed, c("net_max_drawdown"))).alias("fixed_max_drawdown"),
        F.min(F.when(worst, c("net_total_return"))).alias("worst_historical_net_return"),
        F.min(F.when(worst, c("net_max_drawdown"))).alias("worst_historical_max_drawdown"),
    )
    syn = synth.select(
        "symbol", "cand",
        c("net_total_return").alias("synthetic_net_total_return"),
        c("net_max_drawdown").alias("synthetic_net_max_drawdown"),
        c("terminal_nav").alias("synthetic_terminal_nav"),
    )
    first = bars.groupBy("symbol").agg(F.min("ts").alias("_first"))
    df = syn.join(per, ["symbol", "cand"], "left").join(first, "symbol", "left")
    na = c("_first") > F.lit(s.fixed_end).cast("timestamp")
    found = F.coalesce(c("_worst"), F.lit(0))
    gone = found == 0
    reasons = failures(
        fixed_net_return=na | (c("fixed_net_return") >= s.minimum_fixed_return),
        fixed_drawdown=na | (c("fixed_max_drawdown") >= -abs(s.maximum_fixed_drawdown)),
        missing_worst_market_windows=found >= s.window_count,
        worst_window_net_return=gone | (c("worst_historical_net_return") >= s.minimum_worst_return),
        worst_window_drawdown=gone | (c("worst_historical_max_drawdown") >= -abs(s.maximum_worst_drawdown)),
        synthetic_total_return=c("synthetic_net_total_return") >= s.minimum_synthetic_return,
        synthetic_drawdown=c("synthetic_net_max_drawdown") >= -abs(s.maximum_synthetic_drawdown),
        synthetic_terminal_nav=c("synthetic_terminal_nav") >= s.minimum_synthetic_nav,
    )
    return df.withColumns({"layer3_pass": F.size(reasons) == 0, "failure_reason": F.array_join(reasons, ";")}).drop("_first", "_worst")
