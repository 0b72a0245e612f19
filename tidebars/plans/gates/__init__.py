"""The four validation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def failures(**checks: Column) -> Column:
    """Names of the checks that fail. A missing value fails its check."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))


def every_candidate(bars: DataFrame, count: int) -> DataFrame:
    """(symbol, cand) of the first ``count`` parameter sets on every series: what a gate must answer for."""
    return bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("cand"))


def links_table(df: DataFrame, links: list[tuple[int, int, int]]) -> DataFrame:
    """Which parameter set (``cand``) is a variant of which parent, as a small table."""
    return F.broadcast(df.sparkSession.createDataFrame(links, "parent int, cand int, param_order int"))
