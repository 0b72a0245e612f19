"""Gate 4: permutation test, trade bootstrap, deflated Sharpe ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from tidebars.functions import normal
from tidebars.operators import backtest as bt
from tidebars.plans.gates import failures
from tidebars.session import fan_out



@dataclass(frozen=True)
class Resampling:
    permutations: int = 2000
    bootstraps: int = 5000
    maximum_p_value: float = 0.05
    maximum_drawdown_p95: float = 0.40
    maximum_probability_negative: float = 0.20
    minimum_dsr_probability: float = 0.95
    minimum_trades: int = 30


def draw(*parts: Column | str) -> Column:
    """A 32-bit integer fixed by its labels alone, whatever the partitioning or run."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 8), 16, 10).cast("long")


def label() -> Column:
    """Stable name of a candidate for its draws."""
    return F.concat_ws("__", "family", "symbol", "params_key")


# --- circular shifts -----------------------------------------------------------------
def prefix_returns(numbered: DataFrame) -> DataFrame:
    """Per series and bar: market return and its running sums (plain and squared)."""
    order = Window.partitionBy("symbol").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("next_open") / F.nullif(F.col("open"), F.lit(0.0)) - 1
    bars = numbered.filter(F.col("next_open").isNotNull()).select("symbol", "bar_no", r.alias("r"))
    return bars.select(
        "symbol", F.col("bar_no").alias("k"), "r",
        F.sum("r").over(order).alias("s_after"),
        F.sum(F.col("r") * F.col("r")).over(order).alias("q_after"),
    )


def run_edges(book: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Invested runs of each candidate with the cost charged on their first bar."""
    w = Window.partitionBy(*keys).orderBy("bar_no")
    first = F.col("prev_ts").isNull() | (F.col("executed") != F.col("before"))
    df = book.withColumn("g", F.sum(first.cast("int")).over(w))
    return df.groupBy(*keys, "g").agg(
        F.first("executed").alias("direction"),
        F.min("bar_no").alias("i0"),
        F.max("bar_no").alias("i1"),
        F.min_by("transaction_cost", "bar_no").alias("cost"),
    ).filter("direction <> 0")


def permutation_test(book: DataFrame, numbered: DataFrame, count: int = 2000, keys: tuple[str, ...] = ("family", "symbol", "params_key")) -> DataFrame:
    """Observed Sharpe against market returns shifted around a fixed position schedule.

    Within a run the position is constant and costs fall on its first bar, so the sum and
    the sum of squares of a shifted series need only the running sums at both run ends.
    The join is runs x shifts, not bars x shifts.
    """
    prefix = prefix_returns(numbered)
    whole = book.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"),
        F.avg("net_return").alias("m"), F.stddev_samp("net_return").alias("sd"),
        F.sum("transaction_cost").alias("c1"), F.sum(F.col("transaction_cost") * F.col("transaction_cost")).alias("c2"),
    ).withColumn("ppy", bt.periods_per_year(F.col("n"), F.col("a"), F.col("b"))).filter("n >= 3")
    totals = prefix.groupBy("symbol").agg(F.max_by("s_after", "k").alias("s_all"), F.max_by("q_after", "k").alias("q_all"))
    shifts = whole.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("j")).withColumn(
        "shift", (1 + draw(label(), F.lit("shift"), F.col("j").cast("string")) % (F.col("n") - 1)).cast("int")
    )
    moved = (
        run_edges(book, keys).join(shifts, [*keys])
        .withColumns({"ka": F.pmod(F.col("i0") - F.col("shift"), F.col("n")).cast("int"), "kb": F.pmod(F.col("i1") - F.col("shift"), F.col("n")).cast("int")})
    )
    first = prefix.select("symbol", F.col("k").alias("ka"), F.col("r").alias("ra"), (F.col("s_after") - F.col("r")).alias("sa"), (F.col("q_after") - F.col("r") * F.col("r")).alias("qa"))
    last = prefix.select("symbol", F.col("k").alias("kb"), F.col("s_after").alias("sb"), F.col("q_after").alias("qb"))
    c = F.col
    wrap = c("ka") > c("kb")
    ends = moved.join(first, ["symbol", "ka"]).join(last, ["symbol", "kb"]).join(totals, "symbol")
    held = c("sb") - c("sa") + F.when(wrap, c("s_all")).otherwise(0.0)
    held2 = c("qb") - c("qa") + F.when(wrap, c("q_all")).otherwise(0.0)
    sums = ends.groupBy(*keys, "j").agg(
        F.sum(c("direction") * held).alias("x1"),
        F.sum(held2 - 2 * c("direction") * c("cost") * c("ra")).alias("x2"),
    )
    # Candidates that never invest keep their (costless) series under every shift.
    every = shifts.select(*keys, "j").join(sums, [*keys, "j"], "left").join(whole, [*keys])
    total = F.coalesce(c("x1"), F.lit(0.0)) - c("c1")
    square = F.coalesce(c("x2"), F.lit(0.0)) + c("c2")
    var = (square - total * total / c("n")) / (c("n") - 1)
    sharpe = F.when(var > 1e-24, total / c("n") / F.sqrt(var) * F.sqrt("ppy"))
    observed = F.when(c("sd") > 1e-15, c("m") / c("sd") * F.sqrt("ppy"))
    # Sums by running totals carry rounding noise; equal Sharpes must count as reached.
    reached = F.col("null_sharpe") >= F.col("observed_net_sharpe") - 1e-9
    return (
        every.select(*keys, observed.alias("observed_net_sharpe"), sharpe.alias("null_sharpe"))
        .groupBy(*keys, "observed_net_sharpe")
        .agg(
            F.count("null_sharpe").alias("permutation_count"),
            F.avg("null_sharpe").alias("permutation_mean_sharpe"),
            F.percentile("null_sharpe", F.lit(0.5)).alias("permutation_median_sharpe"),
            F.percentile("null_sharpe", F.lit(0.95)).alias("permutation_sharpe_p95"),
            ((1 + F.count_if(reached)) / (F.count("null_sharpe") + 1)).alias("permutation_p_value"),
        )
        .withColumn("permutation_p_value", F.when(F.col("permutation_count") > 0, F.col("permutation_p_value")))
    )


# --- trade bootstrap -----------------------------------------------------------------
REPLICATES_PER_TASK = 100


def trade_bootstrap(trade_table: DataFrame, count: int = 5000, keys: tuple[str, ...] = ("family", "symbol", "params_key")) -> DataFrame:
    """Trade sequences redrawn with replacement: total return and drawdown from NAV 1.

    A candidate's trades (one list, bounded by its bars) are sent to tasks that redraw a
    hundred sequences each by looking trades up in the list; what leaves a task is two
    numbers per sequence. Candidates with a trade at or below -100 %, which cannot be
    compounded, give no row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("trade_group", "net_trade_return")))
    lists = trade_table.groupBy(*keys).agg(ordered.alias("t")).select(*keys, F.transform("t", lambda x: x["net_trade_return"]).alias("r"))
    pieces = lists.filter(F.array_min("r") > -1).select(
        *keys,
        label().alias("label"),
        F.transform("r", lambda x: F.log1p(F.greatest(x, F.lit(-1 + 1e-15)))).alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit((count - 1) // REPLICATES_PER_TASK))).alias("piece"),
    )
    first = F.col("piece") * REPLICATES_PER_TASK
    reps = pieces.repartition(fan_out(trade_table.sparkSession), *keys, "piece").select(
        *keys, "label", "g", F.explode(F.sequence(first + 1, F.least(first + REPLICATES_PER_TASK, F.lit(count)))).alias("rep")
    )
    n = F.size("g")
    pick = lambda slot: F.get("g", (draw(F.col("label"), F.lit("boot"), F.col("rep").cast("string"), slot.cast("string")) % n).cast("int"))
    paths = reps.select(*keys, n.alias("n"), F.transform(F.sequence(F.lit(0), n - 1), pick).alias("path"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("nav"), zero.alias("peak"), zero.alias("down"))

    def step(s, g):
        nav = s["nav"] + g
        peak = F.greatest(s["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.least(s["down"], nav - peak).alias("down"))

    reps = paths.select(*keys, "n", F.aggregate("path", start, step).alias("e")).select(
        *keys, "n", F.expm1("e.nav").alias("total"), F.abs(F.least(F.expm1("e.down"), zero)).alias("drawdown")
    )
    q = lambda col, p: F.percentile(col, F.lit(p))
    return reps.groupBy(*keys).agg(
        F.count("*").alias("bootstrap_count"),
        F.max("n").alias("bootstrap_trade_count"),
        q("total", 0.5).alias("bootstrap_median_total_return"),
        q("total", 0.05).alias("bootstrap_total_return_p05"),
        q("total", 0.95).alias("bootstrap_total_return_p95"),
        F.avg((F.col("total") < 0).cast("double")).alias("bootstrap_probability_negative_return"),
        q("drawdown", 0.5).alias("bootstrap_median_max_drawdown"),
        q("drawdown", 0.95).alias("bootstrap_drawdown_p95"),
    )


# --- deflated Sharpe -----------------------------------------------------------------
def moments(book: DataFrame, keys: tuple[str, ...] = ("family", "symbol", "params_key")) -> DataFrame:
    """Per-bar Sharpe with bias-free skewness and (non-excess) kurtosis."""
    x, c = F.col("net_return"), F.col
    m = book.groupBy(*keys).agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
    )
    n = c("n")
    usable = (n >= 3) & (c("sd") > 1e-15)
    skew = c("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * F.nullif(n - 3, F.lit(0.0))) * ((n + 1) * c("g2") + 6) + 3
    return m.select(
        *keys,
        n.cast("long").alias("dsr_observation_count"),
        F.when(usable, c("mean") / c("sd")).alias("dsr_period_sharpe"),
        F.when(usable, skew).alias("dsr_skewness"),
        F.when(usable, kurt).alias("dsr_kurtosis"),
    )


def deflated_sharpe(moment_table: DataFrame, trials: DataFrame) -> DataFrame:
    """Probability that the Sharpe exceeds the best one expected from that many trials (``trials``: one row, one number)."""
    c, n = F.col, F.col("dsr_observation_count")
    s = c("dsr_period_sharpe")
    spread = 1 - c("dsr_skewness") * s + (c("dsr_kurtosis") - 1) / 4 * s * s
    df = moment_table.withColumn("_v", F.when(spread > 0, spread)).crossJoin(F.broadcast(trials.select(F.col("trials").cast("long").alias("dsr_trial_count"))))
    df = df.withColumn("dsr_sharpe_standard_error", F.sqrt(c("_v") / (n - 1)))
    df = df.withColumn("dsr_benchmark_sharpe", c("dsr_sharpe_standard_error") * F.expr(normal.expected_maximum("dsr_trial_count")))
    stat = (s - c("dsr_benchmark_sharpe")) * F.sqrt(n - 1) / F.sqrt("_v")
    df = df.withColumn("_z", stat).withColumn("dsr_probability", F.expr(normal.distribution("_z")))
    return df.drop("_v", "_z")


def judge(perm: DataFrame, boot: DataFrame, dsr: DataFrame, keys: tuple[str, ...] = ("family", "symbol", "params_key"), r: Resampling = Resampling()) -> DataFrame:
    """A candidate without compoundable trades cannot be bootstrapped and fails for it."""
    c = F.col
    df = dsr.join(perm, [*keys], "left").join(boot, [*keys], "left")
    reasons = F.when(c("bootstrap_count").isNull(), F.array(F.lit("No valid trade returns available."))).otherwise(
        failures(
            permutation_p_value=c("permutation_p_value") < r.maximum_p_value,
            bootstrap_trade_count=c("bootstrap_trade_count") >= r.minimum_trades,
            bootstrap_drawdown_p95=c("bootstrap_drawdown_p95") <= r.maximum_drawdown_p95,
            bootstrap_probability_negative_return=c("bootstrap_probability_negative_return") < r.maximum_probability_negative,
            deflated_sharpe_probability=c("dsr_probability") >= r.minimum_dsr_probability,
        )
    )
    return df.withColumns({"layer4_pass": F.size(reasons) == 0, "failure_reason": F.array_join(reasons, ";")})
