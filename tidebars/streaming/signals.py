"""Live signals: exponential means and positions carried as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars import schemas
from tidebars.session import shared_folder
from tidebars.streaming.bars import rocksdb, run_to_end, versions

OUTPUT = "symbol string, ts timestamp, fast double, slow double, target int, executed int"


class CrossSignal(StatefulProcessor):
    """Fast against slow exponential mean of the close, per symbol."""

    def __init__(self, fast: int, slow: int) -> None:
        self.spans = (fast, slow)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cross", "n long, fast double, slow double, target int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts")
        n, fast, slow, target = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0)
        means = []
        for last, span in zip((fast, slow), self.spans):
            # One more row in front restarts the recursion where it stopped.
            series = pd.Series(np.concatenate([[last], pdf["close"]]) if n else pdf["close"].to_numpy())
            means.append(series.ewm(span=span, adjust=False).mean().to_numpy()[-len(pdf):])
        seen = n + 1 + np.arange(len(pdf))
        a, b = (np.where(seen >= span, m, np.nan) for m, span in zip(means, self.spans))
        now = np.where(a > b, 1, np.where(a < b, -1, 0)).astype("int32")
        executed = np.concatenate([[target], now[:-1]]).astype("int32")
        self.state.update((int(n + len(pdf)), float(means[0][-1]), float(means[1][-1]), int(now[-1])))
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].to_numpy(), "fast": a, "slow": b, "target": now, "executed": executed})

    def close(self) -> None:
        pass


def stream_cross(spark: SparkSession, bars: DataFrame, fast: int = 12, slow: int = 72) -> DataFrame:
    """Stored bars replayed through the stateful signal in two consecutive runs.

    The second run resumes from the first one's checkpoint, as a restarted job would;
    results must equal the batch computation.
    """
    feed_path, out_path = shared_folder(spark, "feed"), shared_folder(spark, "signals")
    schema = T.StructType([f for f in schemas.BARS if f.name in ("symbol", "ts", "close")])
    # The feed is in time order: everything before one moment, then the rest.
    span = bars.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b")).first()
    middle = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(((span["a"] or 0) + (span["b"] or 0)) // 2)
    with rocksdb(spark):
        for part in (middle, ~middle):
            bars.filter(part).select("symbol", "ts", "close").write.mode("append").parquet(feed_path)
            feed = spark.readStream.schema(schema).parquet(feed_path)
            signal = feed.groupBy("symbol").transformWithStateInPandas(
                statefulProcessor=CrossSignal(fast, slow), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
            )
            done = run_to_end(signal, "append", "signals", out_path)
    out = versions(spark, done, signal.schema).drop("version")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("fast", "slow")})
