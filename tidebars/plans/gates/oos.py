"""Gate 1: chronological split, out-of-sample criteria, parameter sensitivity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window

from tidebars.operators import backtest as bt
from tidebars.operators.candidates import variant_plan
from tidebars.operators.positions import named, positions
from tidebars.plans.families import Params
from tidebars.plans.gates import every_candidate, failures, links_table

TOP_TRADES = 5


@dataclass(frozen=True)
class Split:
    in_sample_start: str = "2020-01-01 00:00:00"
    in_sample_end: str = "2023-12-31 23:59:59"
    out_of_sample_start: str = "2024-01-01 00:00:00"

    def start(self):
        ts = lambda t: F.lit(t).cast("timestamp")
        return F.when(F.col("win") == "is", ts(self.in_sample_start)).otherwise(ts(self.out_of_sample_start))


@dataclass(frozen=True)
class Criteria:
    minimum_sharpe: float = 0.30
    minimum_return: float = 0.0
    minimum_trades: int = 30
    maximum_top_share: float = 0.50
    minimum_positive_neighbors: int = 3
    minimum_median_neighbor_sharpe: float = 0.0
    minimum_worst_neighbor_sharpe: float = -0.50


KEYS = ("symbol", "cand", "win")


def split_book(book: DataFrame, split: Split) -> DataFrame:
    """Rows of both samples, ends inclusive, labelled ``is`` and ``oos``."""
    ts = F.col("ts")
    inside = (ts >= F.lit(split.in_sample_start).cast("timestamp")) & (ts <= F.lit(split.in_sample_end).cast("timestamp"))
    label = F.when(inside, "is").when(ts >= F.lit(split.out_of_sample_start).cast("timestamp"), "oos")
    return book.withColumn("win", label).filter(F.col("win").isNotNull())


def window_runs(book: DataFrame, split: Split) -> DataFrame:
    segs = bt.segments(split_book(book, split), KEYS, window_start=split.start())
    return bt.runs(segs, KEYS)


def top_share(run_table: DataFrame, keys: tuple[str, ...] = KEYS, top: int = TOP_TRADES) -> DataFrame:
    """Share of all winning trades' profit earned by the five best; 1 without winners."""
    profit = F.when((F.col("direction") != 0) & (F.col("growth_net") > 1), F.col("growth_net") - 1)
    w = Window.partitionBy(*keys).orderBy(F.col("_p").desc_nulls_last(), "trade_group")
    ranked = run_table.withColumn("_p", profit).withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(
        F.when(F.count_if(F.col("direction") != 0) > 0, F.coalesce(
            F.sum(F.when(F.col("_r") <= top, F.col("_p"))) / F.sum("_p"), F.lit(1.0)
        )).alias("top_5_trade_profit_share")
    )


def window_metrics(run_table: DataFrame) -> DataFrame:
    """Metrics per candidate and sample, with the concentration of profits."""
    return bt.metrics(run_table, KEYS).join(top_share(run_table), [*KEYS])


def performance(oos: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    reasons = failures(
        oos_net_sharpe=F.col("net_sharpe") >= c.minimum_sharpe,
        oos_net_return=F.col("net_total_return") > c.minimum_return,
        oos_trade_count=F.col("trade_count") >= c.minimum_trades,
        trade_profit_concentration=F.col("top_5_trade_profit_share") <= c.maximum_top_share,
    )
    return oos.withColumn("performance_failures", reasons)


def sensitivity(oos: DataFrame, links: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """Neighbour statistics of each parent from the metrics of all parameter sets."""
    near = oos.join(links, "cand").groupBy("symbol", "parent").agg(
        F.count("*").alias("neighbor_count"),
        F.count_if((F.col("net_total_return") > 0) & F.col("net_sharpe").isNotNull()).alias("positive_neighbor_count"),
        F.median("net_sharpe").alias("median_neighbor_sharpe"),
        F.min("net_sharpe").alias("worst_neighbor_sharpe"),
    )
    reasons = failures(
        positive_neighbor_count=F.col("positive_neighbor_count") >= c.minimum_positive_neighbors,
        median_neighbor_sharpe=F.col("median_neighbor_sharpe") >= c.minimum_median_neighbor_sharpe,
        worst_neighbor_sharpe=F.col("worst_neighbor_sharpe") >= c.minimum_worst_neighbor_sharpe,
    )
    return near.withColumn("sensitivity_failures", reasons)


def neighbor_metrics(bars: DataFrame, family: str, parents: list[Params], split: Split):
    """Out-of-sample metrics of parents and neighbours, each parameter set run once."""
    plan, links = variant_plan(family, parents, include_self=False)
    book = bt.ledger(positions(bars, plan))
    runs = window_runs(book, split).filter(F.col("win") == "oos")
    return window_metrics(runs), links_table(bars, links), plan


def gate(bars: DataFrame, family: str, parents: list[Params], split: Split, c: Criteria = Criteria()) -> DataFrame:
    """Verdict of every parent on every series; one without out-of-sample bars fails for that."""
    oos, links, plan = neighbor_metrics(bars, family, parents, split)
    near = sensitivity(oos, links, c)
    own = performance(oos, c).filter(F.col("cand") < len(parents))
    none = F.array(F.lit("no_valid_neighbors"))
    listed = every_candidate(bars, len(parents)).join(own, ["symbol", "cand"], "left")
    joined = listed.join(near.withColumnRenamed("parent", "cand"), ["symbol", "cand"], "left")
    unseen = F.array(F.lit("no_oos_observations"))
    reasons = F.coalesce(F.concat("performance_failures", F.coalesce("sensitivity_failures", none)), unseen)
    out = joined.withColumns({"layer1_pass": F.size(reasons) == 0, "failure_reason": F.array_join(reasons, ";")})
    return named(out, plan)
