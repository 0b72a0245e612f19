"""Stored tables: bar scans and sinks, keyed upserts, incremental top-ups, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidebars import schemas
from tidebars.operators.quality import keep_last
from tidebars.session import materialize

OVERLAP_HOURS = 72


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per symbol and month, rows in time order inside each file.

    Each (symbol, month) has a writer of its own, so a heavy symbol is written by many tasks. With dynamic overwrite only
    the months that ``bars`` holds are replaced.
    """
    (
        bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
        .repartition("symbol", "month")
        .sortWithinPartitions("symbol", "month", "ts")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol", "month")
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    fields = [f for f in schema.fields if f.name not in ("symbol", "month")]
    return spark.read.schema(T.StructType([*fields, T.StructField("symbol", T.StringType()), T.StructField("month", T.StringType())])).parquet(path)


def scan_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, schema=schemas.BARS) -> DataFrame:
    """Bars from a folder written by ``write_bars``; a symbol list prunes whole folders."""
    df = _stored(spark, path, schema)
    return (df.filter(F.col("symbol").isin(symbols)) if symbols else df).select(*[f.name for f in schema.fields])


def decode_series(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """Observations of JSON series documents; ``.`` marks a missing value."""
    shape = "observations array<struct<date:string,value:string>>"
    return (
        payloads.select("series_id", F.explode(F.from_json(body, shape)["observations"]).alias("o"))
        .filter(F.col("o.value") != ".")
        .select("series_id", F.to_timestamp("o.date", "yyyy-MM-dd").alias("date"), F.col("o.value").cast("double").alias("value"))
    )


def epoch_to_timestamp(rows: DataFrame, seconds: str = "epoch") -> DataFrame:
    """Epoch seconds to UTC timestamps, one row per timestamp (the last received)."""
    return keep_last(rows.withColumn("ts", F.timestamp_seconds(F.col(seconds))).drop(seconds)).drop("_copies")


def stitch(chunks: list[DataFrame], floor: Column) -> DataFrame:
    """Backfill chunks joined into one history that starts no earlier than ``floor``."""
    rows = None
    for i, chunk in enumerate(chunks):
        chunk = chunk.withColumn("ingest_seq", F.lit(i))
        rows = chunk if rows is None else rows.unionByName(chunk)
    return keep_last(rows).drop("_copies", "ingest_seq").filter(F.col("ts") >= floor)


def top_up(stored: DataFrame, incoming: DataFrame, floor: Column, overlap_hours: int = OVERLAP_HOURS) -> DataFrame:
    """Stored history plus incoming bars from 72 hours before each symbol's last bar.

    Inside the overlap the incoming bar replaces the stored one.
    """
    last = stored.groupBy("symbol").agg(F.max("ts").alias("_last"))
    start = F.greatest(floor, F.col("_last") - F.expr(f"interval {overlap_hours} hours"))
    fresh = (
        incoming.join(last, "symbol", "left")
        .filter(F.col("ts") >= F.coalesce(start, floor))
        .drop("_last")
        .withColumn("ingest_seq", F.lit(1))
    )
    return keep_last(stored.withColumn("ingest_seq", F.lit(0)).unionByName(fresh)).drop("_copies", "ingest_seq")


def top_up_stored(spark: SparkSession, path: str, incoming: DataFrame, floor: Column, overlap_hours: int = OVERLAP_HOURS) -> None:
    """``top_up`` in place: only months from the overlap on are read, merged and rewritten.

    The newest month of each symbol comes from the folder names, its last bar from that month's files alone.
    """
    schema = incoming.schema
    names = [f.name for f in schema.fields]
    stored = _stored(spark, path, schema)
    newest = stored.select("symbol", "month").groupBy("symbol").agg(F.max("month").alias("month"))
    last = stored.join(newest, ["symbol", "month"]).groupBy("symbol").agg(F.max("ts").alias("last"))
    start = F.coalesce(F.greatest(floor, F.col("last") - F.expr(f"interval {overlap_hours} hours")), floor)
    begin = materialize(last.select("symbol", start.alias("begin"), F.date_format(start, "yyyy-MM").alias("first_month")), "begin")
    touched = stored.join(begin, "symbol").filter("month >= first_month").select(*names, F.lit(0).alias("ingest_seq"))
    fresh = incoming.join(begin, "symbol", "left").filter(F.col("ts") >= F.coalesce("begin", floor)).select(*names, F.lit(1).alias("ingest_seq"))
    merged = keep_last(touched.unionByName(fresh)).select(*names)
    write_bars(materialize(merged, "merged"), path)


def join_price_spread(prices: DataFrame, spreads: DataFrame) -> DataFrame:
    return prices.join(spreads, ["symbol", "ts"])


def upsert(existing: DataFrame, new: DataFrame, key: str = "candidate_id") -> DataFrame:
    """New rows replace stored rows of the same key; all others carry over."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def write_reports(rows: DataFrame, path: str, fmt: str = "json") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path)
