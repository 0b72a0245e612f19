"""Stored bars kept up to date by a stream of new and corrected bars, each batch applied exactly once.

A batch touches some months of some symbols. It reads these months as they are, merges its rows (per bar the greatest
``ingest_seq`` wins, the incoming row on a tie), writes the merged months to a folder of its own version and then commits
a small file that names them. Readers follow the commit log: of each month the newest committed version, so they see the
table as it was after some batch, never half of one. A batch that is replayed after a crash overwrites its own version
if it was not committed, and does nothing if it was. Older versions stay for readers that still hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidebars.operators.quality import keep_last
from tidebars.session import materialize, shared_folder

MONTH = ["symbol", "month"]
LOG = "symbol string, month string, version long"


def committed(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """``symbol``, ``month`` and the newest committed ``version`` of it, as of batch ``upto`` if given."""
    files = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    log = files if upto is None else files.where(F.col("version") <= upto)
    return log.groupBy(*MONTH).agg(F.max("version").alias("version"))


def _exists(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def create(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table: a log without entries and a version without months."""
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{path}/log/start")
    empty = T.StructType([f for f in schema.fields if f.name not in MONTH])
    spark.createDataFrame([], empty).write.mode("ignore").parquet(f"{path}/data/version=-1/symbol=none/month=none")


def read(spark: SparkSession, path: str, schema: T.StructType, months: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """The bars of the newest snapshot (or the one after batch ``upto``), of some ``months`` only if given.

    Versions and months are folders, so the join with the log prunes all others.
    """
    names = [f.name for f in schema.fields]
    fields = [f for f in schema.fields if f.name not in MONTH]
    folders = [T.StructField("version", T.LongType()), *[T.StructField(c, T.StringType()) for c in MONTH]]
    rows = spark.read.schema(T.StructType([*fields, *folders])).option("basePath", f"{path}/data").parquet(f"{path}/data")
    live = committed(spark, path, upto)
    live = live if months is None else live.join(months, MONTH, "left_semi")
    return rows.join(live, [*MONTH, "version"], "left_semi").select(*names)


def merge_batch(batch: DataFrame, version: int, path: str) -> bool:
    """Applies one batch; false if it had been applied before."""
    spark = batch.sparkSession
    entry = f"{path}/log/batch={version}"
    if _exists(spark, f"{entry}/_SUCCESS"):
        return False
    names = batch.columns
    new = materialize(batch.withColumn("month", F.date_format("ts", "yyyy-MM")), "incoming")
    touched = new.select(*MONTH).distinct()
    # Only versions before this one: what an interrupted try of this batch wrote is not an input.
    old = read(spark, path, batch.schema, touched, version - 1).withColumn("arrival", F.lit(0))
    both = old.unionByName(new.select(*names, F.lit(1).alias("arrival"))).withColumn("rank", F.struct("ingest_seq", "arrival"))
    merged = keep_last(both, ("symbol", "ts"), "rank").select(*names).withColumn("month", F.date_format("ts", "yyyy-MM"))
    merged.repartition(*MONTH).sortWithinPartitions(*MONTH, "ts").write.mode("overwrite").partitionBy(*MONTH).parquet(f"{path}/data/version={version}")
    touched.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.mode("overwrite").parquet(entry)
    return True


def follow(spark: SparkSession, feed: DataFrame, path: str) -> None:
    """All batches of ``feed`` that have not been merged yet; resumes from the table's own checkpoint."""
    create(spark, path, feed.schema)

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path)

    stream = feed.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start()
    stream.awaitTermination()


def replay(spark: SparkSession, bars: DataFrame, parts: int = 3) -> DataFrame:
    """Bars sent in ``parts`` interleaved portions, then corrections of every fourth: close doubled, and older versions of every fifth.

    The older versions must change nothing.
    """
    feed_path, path = shared_folder(spark, "feed"), shared_folder(spark, "corrected")
    draw = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600, F.lit(60)).cast("int")
    rows = materialize(bars.withColumns({"ingest_seq": F.lit(2).cast("long"), "draw": draw}), "sent")
    fixed = rows.where("draw % 4 = 0").withColumns({"close": F.col("close") * 2, "ingest_seq": F.lit(3).cast("long")})
    older = rows.where("draw % 5 = 0").withColumns({"close": F.lit(0.0), "ingest_seq": F.lit(1).cast("long")})
    for k in range(parts + 1):
        sent = rows.where(F.col("draw") % parts == k) if k < parts else fixed.unionByName(older)
        sent.drop("draw").write.mode("append").parquet(feed_path)
        follow(spark, spark.readStream.schema(rows.drop("draw").schema).parquet(feed_path), path)
    return read(spark, path, rows.drop("draw").schema)
