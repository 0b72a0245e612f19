"""Funnel, failure and ranking reports over gate result tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

LAYERS = (1, 2, 3, 4)
PASSES = [f"layer{i}_pass" for i in LAYERS]


def final_funnel(l1: DataFrame, l2: DataFrame, l3: DataFrame, l4: DataFrame) -> DataFrame:
    """One row per candidate with all four decisions; a missing decision is a fail."""
    df = l1.select("candidate_id", "family", "symbol", "layer1_pass")
    for i, other in zip((2, 3, 4), (l2, l3, l4)):
        df = df.join(other.select("candidate_id", f"layer{i}_pass"), "candidate_id", "left")
    df = df.withColumns({p: F.coalesce(p, F.lit(False)) for p in PASSES})
    return df.withColumn("final_pass", reduce(lambda a, b: a & b, [F.col(p) for p in PASSES]))


def funnel_mismatches(funnel: DataFrame, metrics: DataFrame) -> DataFrame:
    """Candidates on one side only, or repeated; a sound funnel has none."""
    a = funnel.groupBy("candidate_id").agg(F.count("*").alias("in_funnel"))
    b = metrics.groupBy("candidate_id").agg(F.count("*").alias("in_metrics"))
    return a.join(b, "candidate_id", "full_outer").filter(
        F.col("in_funnel").isNull() | F.col("in_metrics").isNull() | (F.col("in_funnel") > 1)
    )


def survivors(funnel: DataFrame, *tables: DataFrame) -> DataFrame:
    """Passing candidates with columns of each table (one row per candidate) attached."""
    out = funnel.filter("final_pass")
    for t in tables:
        out = out.join(t, "candidate_id", "left")
    return out


def _counts(funnel: DataFrame) -> DataFrame:
    """All funnel counts in one pass."""
    upto = lambda i: reduce(lambda a, b: a & b, [F.col(p) for p in PASSES[:i]])
    return funnel.agg(
        F.count("*").alias("n"),
        *[F.count_if(upto(i)).alias(f"upto{i}") for i in LAYERS],
        *[F.count_if(p).alias(f"only{i}") for i, p in zip(LAYERS, PASSES)],
        F.count_if("final_pass").alias("final"),
    )


def cumulative_funnel(funnel: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit("Generated").alias("stage"), F.col("n").alias("survivors"))]
    rows += [F.struct(F.lit(f"Layer {i}").alias("stage"), F.col(f"upto{i}").alias("survivors")) for i in LAYERS]
    return _counts(funnel).select(F.inline(F.array(*rows)))


def gate_summary(funnel: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f"Layer {i}").alias("layer"),
            F.col(f"only{i}").alias("independent_passes"),
            (F.col("n") - F.col(f"only{i}")).alias("independent_failures"),
            (F.col(f"only{i}") / F.col("n")).alias("independent_pass_rate"),
        )
        for i in LAYERS
    ]
    return _counts(funnel).select(F.inline(F.array(*rows)))


def gate_pass_rates(funnel: DataFrame) -> DataFrame:
    rows = [
        F.struct(F.lit(g).alias("gate"), (F.col(c) / F.col("n") * 100).alias("pass_rate"))
        for g, c in [*zip(PASSES, [f"only{i}" for i in LAYERS]), ("final_pass", "final")]
    ]
    return _counts(funnel).select(F.inline(F.array(*rows)))


def failure_reasons(layers: dict[str, DataFrame]) -> DataFrame:
    """One row per failed candidate, layer and reason."""
    parts = [
        df.filter(~F.col(f"{name}_pass")).select(
            "candidate_id", "family", "symbol", F.lit(name).alias("layer"),
            F.explode(F.split(F.coalesce("failure_reason", F.lit("")), ";")).alias("failure_reason"),
        )
        for name, df in layers.items()
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("failure_reason") != "")


def failure_summary(layers: dict[str, DataFrame]) -> DataFrame:
    return failure_reasons(layers).groupBy("layer", "failure_reason").agg(F.count("*").alias("candidate_failures"))


def top_reasons(layers: dict[str, DataFrame], k: int = 12) -> DataFrame:
    total = failure_reasons(layers).groupBy("failure_reason").agg(F.count("*").alias("candidate_failures"))
    return total.orderBy(F.col("candidate_failures").desc(), "failure_reason").limit(k)


def family_symbol(metrics: DataFrame, funnel: DataFrame) -> DataFrame:
    joined = metrics.join(funnel, ["candidate_id", "family", "symbol"])
    return joined.groupBy("family", "symbol").agg(
        F.count("candidate_id").alias("candidate_count"),
        F.median("net_sharpe").alias("median_full_sample_sharpe"),
        *[F.count_if(p).alias(f"layer{i}_passes") for i, p in zip(LAYERS, PASSES)],
        F.count_if("final_pass").alias("final_survivors"),
    )


def _rank_key() -> Column:
    return F.struct(F.col("net_sharpe"), F.col("candidate_id"))


def report_summary(metrics: DataFrame, funnel: DataFrame) -> DataFrame:
    best = metrics.filter("net_sharpe is not null").agg(F.max(_rank_key()).alias("b"))
    return (
        funnel.agg(F.count("*").alias("official_candidate_count"), F.count_if("final_pass").alias("final_survivor_count"))
        .withColumn("final_survival_rate", F.col("final_survivor_count") / F.col("official_candidate_count"))
        .join(best, F.lit(True))
        .select(
            "official_candidate_count", "final_survivor_count", "final_survival_rate",
            F.col("b.candidate_id").alias("best_full_sample_candidate"), F.col("b.net_sharpe").alias("best_full_sample_net_sharpe"),
        )
    )


#: Decimals kept before a figure is printed: what lies beyond depends on the order in which a mean was summed.
KEPT_DECIMALS = 9


def printed(value: Column, decimals: int) -> Column:
    """Fixed decimals of the double's exact value, halves to even, as C and Python print it; an undefined value gives the empty text.

    ``format_string`` rounds the shortest decimal form half up instead, and so differs on ties.
    """

    @F.pandas_udf("string")
    def fixed(x: pd.Series) -> pd.Series:
        return pd.Series([f"{v:.{decimals}f}" if np.isfinite(v) else "" for v in x], dtype=object)

    return fixed(F.round(value, KEPT_DECIMALS) + F.lit(0.0))  # no negative zero


def percent(col: str, decimals: int = 1) -> Column:
    return F.when(F.col(col).isNotNull(), F.concat(printed(F.col(col) * 100, decimals), F.lit("%"))).otherwise("").alias(col)


def decimal(col: str, decimals: int = 2) -> Column:
    return printed(F.col(col), decimals).alias(col)


def top_candidates(metrics: DataFrame, funnel: DataFrame, k: int = 10) -> DataFrame:
    top = (
        metrics.join(funnel, ["candidate_id", "family", "symbol"])
        .orderBy(F.col("net_sharpe").desc_nulls_last(), "candidate_id").limit(k)
    )
    return top.select(
        "candidate_id", percent("net_annual_return"), decimal("net_sharpe"), percent("net_max_drawdown"), "trade_count", *PASSES, "final_pass"
    )


def survivor_table(found: DataFrame, percents: list[str], decimals: list[str]) -> DataFrame:
    """Formatted survivors, or one row with a message when there are none."""
    message = "No candidate passed all four validation layers."
    columns = ["candidate_id", *percents, *decimals]
    rows = found.select(
        F.lit("survivor").alias("result"), "candidate_id", *[percent(c) for c in percents], *[decimal(c, 3) for c in decimals]
    )
    none = found.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(message).alias("result"), *[F.lit(None).cast("string").alias(c) for c in columns]
    )
    return rows.unionByName(none)


def family_status(families: DataFrame, found: DataFrame, deployed: DataFrame) -> DataFrame:
    """families: family, enabled, candidate_count."""
    v = found.groupBy("family").agg(F.count("*").alias("validated_count"))
    d = deployed.groupBy("family").agg(F.count("*").alias("deployed_count"))
    df = families.join(v, "family", "left").join(d, "family", "left").na.fill(0, ["validated_count", "deployed_count"])
    status = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("deployed_count") > 0, "deployed")
        .when(F.col("validated_count") > 0, "validated")
        .otherwise("candidate")
    )
    return df.withColumn("status", status)


def validation_export(funnel: DataFrame, metrics: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Funnel with metrics and the first reason given by any layer."""
    out = funnel.join(metrics.select("candidate_id", "net_sharpe", "net_max_drawdown", "net_annual_return"), "candidate_id", "left")
    names = []
    for name, df in layers.items():
        names.append(f"_{name}")
        out = out.join(df.select("candidate_id", F.nullif("failure_reason", F.lit("")).alias(f"_{name}")), "candidate_id", "left")
    return out.withColumn("failure_reason", F.coalesce(*names)).drop(*names)


def sharpe_histogram(metrics: DataFrame, bins: int = 12) -> DataFrame:
    """Equal-width bins between each family's extremes; the last bin is closed."""
    valid = metrics.filter("net_sharpe is not null")
    ends = valid.groupBy("family").agg(F.min("net_sharpe").alias("lo"), F.max("net_sharpe").alias("hi"))
    share = (F.col("net_sharpe") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    b = F.least(F.floor(F.coalesce(share, F.lit(0.5)) * bins), F.lit(bins - 1)).cast("int")
    return valid.join(ends, "family").groupBy("family", b.alias("bin")).agg(F.count("*").alias("candidates"))


def oos_vs_walkforward(l1: DataFrame, l2: DataFrame) -> DataFrame:
    return (
        l1.select("candidate_id", "oos_net_sharpe").join(l2.select("candidate_id", "walkforward_net_sharpe"), "candidate_id")
        .filter("oos_net_sharpe is not null and walkforward_net_sharpe is not null")
    )


def top_table(export: DataFrame, k: int = 15) -> DataFrame:
    cols = ["candidate_id", "family", "symbol", "net_sharpe", "net_max_drawdown", "net_annual_return", "final_pass", "failure_reason"]
    top = export.orderBy(F.col("net_sharpe").desc_nulls_last(), "candidate_id").limit(k).select(*cols)
    return top.withColumns({c: F.round(c, 3) for c in ("net_sharpe", "net_max_drawdown", "net_annual_return")})
