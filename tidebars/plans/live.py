"""What a live run reads: latest bars, staleness, the newest signal per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

HISTORY_BARS = 500
STALE_HOURS = 3.0


def latest_bars(bars: DataFrame, n: int = HISTORY_BARS) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def staleness(bars: DataFrame, now: Column, hours: float = STALE_HOURS) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_ts")) / 3600
    return last.withColumn("age_hours", age).withColumn("stale", F.col("age_hours") > hours)


def latest_signal(positions: DataFrame, keys: tuple[str, ...] = ("symbol", "cand")) -> DataFrame:
    """The target position of each candidate on its newest bar."""
    return positions.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by("target", "ts").alias("target"))
