"""Gate 2: rolling re-selection of parameters and frozen evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window

from tidebars.operators import backtest as bt
from tidebars.operators.candidates import variant_plan
from tidebars.operators.positions import named, positions
from tidebars.plans.families import REGISTRY, Params
from tidebars.plans.gates import every_candidate, failures, links_table
from tidebars.session import materialize

WEEK = 7 * 86400


@dataclass(frozen=True)
class Plan:
    train_weeks: int = 104
    test_weeks: int = 26
    step_weeks: int = 26
    expanding: bool = False
    minimum_completed_folds: int = 5
    minimum_training_trades: int = 30
    minimum_sharpe: float = 0.25
    minimum_return: float = 0.0
    minimum_profitable_fold_share: float = 0.5
    minimum_trades: int = 30
    maximum_drawdown: float = 0.35


FOLD = ("symbol", "part", "fold")


def fold_count(first, last, p: Plan):
    span = F.unix_timestamp(last) - F.unix_timestamp(first)
    room = span - (p.train_weeks + p.test_weeks) * WEEK
    return F.greatest(F.floor(room / (p.step_weeks * WEEK)) + 1, F.lit(0))


def windows(bars: DataFrame, p: Plan = Plan()) -> DataFrame:
    """Folds of each series: training and test bounds, half open."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    k = ends.withColumn("n", fold_count("first", "last", p)).filter("n > 0").withColumn(
        "fold", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    )
    at = lambda weeks: F.timestamp_seconds(F.unix_timestamp("first") + weeks * WEEK)
    move = (F.col("fold") - 1) * p.step_weeks
    start = F.lit(0) if p.expanding else move
    return k.select(
        "symbol",
        F.col("fold").cast("int").alias("fold"),
        at(start).alias("train_start"),
        at(move + p.train_weeks).alias("train_end"),
        at(move + p.train_weeks).alias("test_start"),
        at(move + p.train_weeks + p.test_weeks).alias("test_end"),
    )


def slices(numbered: DataFrame, p: Plan = Plan()) -> DataFrame:
    """Bars of every training and test fold, numbered afresh so indicators start cold.

    Folds are regular, so the folds a bar belongs to follow from its age; bars are
    copied to them without joining a window table.
    """
    age = F.unix_timestamp("ts") - F.unix_timestamp("first_ts")
    step, train, test = (w * WEEK for w in (p.step_weeks, p.train_weeks, p.test_weeks))
    n = fold_count("first_ts", "last_ts", p)
    after = lambda x: F.floor(x / step)
    train_last = n - 1 if p.expanding else F.least(after(age), n - 1)
    train_first = F.greatest(after(age - train) + 1, F.lit(0))
    test_first = F.greatest(after(age - train - test) + 1, F.lit(0))
    test_last = F.least(after(age - train), n - 1)
    seq = lambda a, b, part: F.when(
        a <= b, F.transform(F.sequence(a, b), lambda k: F.struct(F.lit(part).alias("part"), (k + 1).cast("int").alias("fold")))
    ).otherwise(F.array().cast("array<struct<part:string,fold:int>>"))
    spread = numbered.withColumn("f", F.explode(F.concat(seq(train_first, train_last, "train"), seq(test_first, test_last, "test"))))
    df = spread.withColumns({"part": F.col("f.part"), "fold": F.col("f.fold")}).drop("f")
    base = F.min("bar_no").over(Window.partitionBy(*FOLD))
    df = df.withColumn("bar_no", F.col("bar_no") - base)
    return df.withColumn("prev_ts", F.when(F.col("bar_no") > 0, F.col("prev_ts")))


def fold_segments(numbered: DataFrame, wanted: list[tuple[str, Params]], p: Plan = Plan()) -> DataFrame:
    book = bt.ledger(positions(slices(numbered, p), wanted, FOLD))
    return bt.segments(book, (*FOLD, "cand"), FOLD)


def fold_metrics(segs: DataFrame, part: str) -> DataFrame:
    keys = ("symbol", "fold", "cand")
    return bt.metrics(bt.runs(segs.filter(F.col("part") == part), keys), keys)


def select(train: DataFrame, links: DataFrame, p: Plan = Plan()) -> DataFrame:
    """Best eligible variant of each parent in each training fold, else the parent."""
    c = F.col
    eligible = (c("trade_count") >= p.minimum_training_trades) & c("net_sharpe").isNotNull()
    order = [
        c("eligible").desc(),
        F.when(c("eligible"), c("net_sharpe")).desc_nulls_last(),
        F.when(c("eligible"), F.abs("net_max_drawdown")).asc_nulls_last(),
        F.when(c("eligible"), c("net_total_return")).desc_nulls_last(),
        F.when(c("eligible"), c("trade_count")).asc_nulls_last(),
        F.when(c("eligible"), c("param_order")).asc_nulls_last(),
        (c("cand") == c("parent")).desc(),
    ]
    w = Window.partitionBy("symbol", "fold", "parent").orderBy(*order)
    ranked = train.join(links, "cand").withColumn("eligible", eligible)
    counts = F.sum(c("eligible").cast("int")).over(Window.partitionBy("symbol", "fold", "parent"))
    return (
        ranked.withColumns({"eligible_parameter_count": counts, "_r": F.row_number().over(w)})
        .filter("_r = 1")
        .select(
            "symbol", "fold", "parent", "cand", "eligible_parameter_count",
            (~c("eligible")).alias("fallback_selection_used"),
            c("net_sharpe").alias("training_net_sharpe"),
            c("trade_count").alias("training_trade_count"),
        )
    )


def fold_results(segs: DataFrame, links: DataFrame, p: Plan = Plan()) -> DataFrame:
    """One row per parent and fold: what training chose and how it did in the test."""
    chosen = select(fold_metrics(segs, "train"), links, p)
    test = fold_metrics(segs, "test").select(
        "symbol", "fold", "cand",
        F.col("net_total_return").alias("test_net_return"),
        F.col("net_sharpe").alias("test_net_sharpe"),
        F.col("net_max_drawdown").alias("test_max_drawdown"),
        F.col("trade_count").alias("test_trade_count"),
    )
    return chosen.join(test, ["symbol", "fold", "cand"])


def aggregate(segs: DataFrame, results: DataFrame, labels: list[str], p: Plan = Plan()) -> DataFrame:
    """Concatenated test folds of each parent, and the stability of what was chosen."""
    chosen = results.select("symbol", "fold", "cand", "parent")
    tests = segs.filter(F.col("part") == "test").join(chosen, ["symbol", "fold", "cand"])
    keys = ("symbol", "parent")
    joined = tests.withColumn("b0", F.unix_timestamp("t0"))
    perf = bt.metrics(bt.runs(joined, keys), keys).select(
        *keys,
        F.col("net_sharpe").alias("walkforward_net_sharpe"),
        F.col("net_total_return").alias("walkforward_net_total_return"),
        F.col("net_max_drawdown").alias("walkforward_net_max_drawdown"),
        F.col("total_transaction_cost").alias("walkforward_total_transaction_cost"),
        F.col("observation_count").alias("walkforward_observation_count"),
    )
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("cand") + 1)
    return perf.join(stability(results.withColumn("chosen", label)), [*keys])


def stability(results: DataFrame) -> DataFrame:
    """How the test folds of each parent went, and how stable the choice (``chosen``: its label) was."""
    c = F.col
    keys = ("symbol", "parent")
    uses = F.count("*").over(Window.partitionBy("symbol", "parent", "cand"))
    folds = results.withColumn("uses", uses).groupBy(*keys).agg(
        F.count("*").alias("completed_folds"),
        F.count_if(c("test_net_return") > 0).alias("positive_folds"),
        F.sum("test_trade_count").alias("total_test_trades"),
        F.median("test_net_sharpe").alias("median_window_sharpe"),
        F.min("test_net_sharpe").alias("worst_window_sharpe"),
        F.max("test_net_sharpe").alias("best_window_sharpe"),
        F.median("test_net_return").alias("median_window_return"),
        F.min("test_net_return").alias("worst_window_return"),
        F.countDistinct("cand").alias("selection_unique_count"),
        (F.max("uses") / F.count("*")).alias("selection_mode_share"),
        F.count_if("fallback_selection_used").alias("fallback_fold_count"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c("fold").cast("string"), "chosen"))))).alias("selected_by_fold"),
    )
    share = F.col("positive_folds") / F.col("completed_folds")
    return folds.withColumn("profitable_fold_share", share)


def judge(agg: DataFrame, p: Plan = Plan()) -> DataFrame:
    """A candidate whose series is too short for a single fold fails for that."""
    c = F.col
    reasons = F.when(c("completed_folds").isNull(), F.array(F.lit("no_completed_folds"))).otherwise(F.array_sort(
        failures(
            minimum_completed_folds=c("completed_folds") >= p.minimum_completed_folds,
            minimum_oos_sharpe=c("walkforward_net_sharpe") >= p.minimum_sharpe,
            minimum_oos_return=c("walkforward_net_total_return") > p.minimum_return,
            minimum_profitable_fold_share=c("profitable_fold_share") >= p.minimum_profitable_fold_share,
            minimum_oos_trades=c("total_test_trades") >= p.minimum_trades,
            maximum_drawdown=c("walkforward_net_max_drawdown") >= -abs(p.maximum_drawdown),
        )
    ))
    return agg.withColumns(
        {
            "layer2_pass": F.size(reasons) == 0,
            "failure_reason": F.array_join(reasons, ";"),
            "primary_failure_reason": F.coalesce(F.get(reasons, F.lit(0)), F.lit("")),
        }
    )


def prepare(numbered: DataFrame, family: str, parents: list[Params], p: Plan = Plan()):
    """Stored segments of every variant in every fold, the variant links and the plan."""
    plan, links = variant_plan(family, parents, include_self=True)
    segs = materialize(fold_segments(numbered, plan, p), "folds")
    return segs, links_table(numbered, links), plan


def gate(numbered: DataFrame, family: str, parents: list[Params], p: Plan = Plan()) -> DataFrame:
    segs, links, plan = prepare(numbered, family, parents, p)
    labels = [REGISTRY[f].candidate_key(v) for f, v in plan]
    # A list of folds is small; the metrics behind it are read three times.
    results = materialize(fold_results(segs, links, p), "results")
    listed = every_candidate(numbered, len(parents)).withColumnRenamed("cand", "parent")
    out = judge(listed.join(aggregate(segs, results, labels, p), ["symbol", "parent"], "left"), p)
    return named(out.withColumnRenamed("parent", "cand"), plan)
