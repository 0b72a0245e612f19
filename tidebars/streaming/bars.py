"""Bars from a tick stream, and de-duplicated ticks.

Results leave through ``foreachBatch`` into the shared folder: each micro-batch writes
the rows it changed under its own batch number, so a replayed batch overwrites itself,
and readers keep the newest version of each key. State of bars and of de-duplication is bounded by the
watermark; sessions run in complete mode, which keeps all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidebars.operators.quality import keep_last
from tidebars.session import shared_folder
from tidebars.sources.ticks import order_key

# The overlap the batch top-up refetches is also how late a tick may be.
WATERMARK = "72 hours"

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of several columns and maps needs the RocksDB store; the session's own choice is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; event time must carry a zone to be watermarked."""
    files = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str, purpose: str, path: str | None = None) -> str:
    """Process everything available now; returns the folder of versioned batches.

    A ``path`` used before resumes from its checkpoint.
    """
    path = path or shared_folder(stream.sparkSession, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return f"{path}/data"


def versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
    return spark.read.schema(full).parquet(f"{path}/batch=*")


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    return keep_last(versions(spark, path, schema), keys, "version").drop("version", "_copies")


def bar_aggregates(price: Column) -> list[Column]:
    k = order_key(F.unix_micros("ts"), F.col("event_id"))
    return [
        F.min_by(price, k).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, k).alias("close"),
        F.sum("value").alias("volume"),
        F.count("*").alias("trade_count"),
    ]


def windowed_bars(ticks: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding bars per event type."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    price = 100 + F.col("value") / 10
    return (
        ticks.withWatermark("ts", WATERMARK)
        .groupBy(win.alias("w"), F.col("event_type").alias("symbol"))
        .agg(*bar_aggregates(price))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count")
    )


def sessions(ticks: DataFrame, gap: str = "90 minutes") -> DataFrame:
    """Activity per user bounded by gaps in time."""
    return (
        ticks.withWatermark("ts", WATERMARK)
        .groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id"))
        .agg(F.count("*").alias("ticks"), F.sum("value").alias("volume"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "ticks", "volume")
    )


def stream_bars(spark: SparkSession, sf_dir: str, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    bars = windowed_bars(tick_stream(spark, sf_dir), length, slide)
    return newest(spark, run_to_end(bars, "update", "stream"), bars.schema, ("symbol", "ts"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows merge, so the newest batch holds the whole picture."""
    rows = sessions(tick_stream(spark, sf_dir))
    data = versions(spark, run_to_end(rows, "complete", "sessions"), rows.schema)
    last = data.agg(F.max("version").alias("version"))
    return data.join(F.broadcast(last), "version").drop("version")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with re-sent events, each kept once within the watermark."""
    ticks = tick_stream(spark, sf_dir)
    again = tick_stream(spark, sf_dir).filter(F.col("event_id") % 5 == 0)
    once = (
        ticks.unionByName(again).withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
        .select("event_id", "event_type", "ts", "value")
    )
    return versions(spark, run_to_end(once, "append", "dedup"), once.schema).drop("version")
