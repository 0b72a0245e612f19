"""Bars and macro series from the raw tables.

Ticks are reduced with ``min_by``/``max_by`` aggregates, which combine on the map side:
a symbol that owns a third of all ticks still ships one partial row per bar and task.
The ordering key is one wide decimal: a fixed-width aggregation buffer keeps Spark on
hash aggregation, so the ticks are neither sorted nor shuffled as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

# Which two regions stand for the base and quote side of a symbol.
CURRENCY_LEGS = {
    "A": ("AFRICA", "AMERICA"),
    "N": ("ASIA", "EUROPE"),
    "R": ("EUROPE", "MIDDLE EAST"),
}


def order_key(major: Column, minor: Column) -> Column:
    """Two non-negative integers as one number that sorts by major, then minor."""
    wide = major.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + minor.cast("decimal(18,0)")
    return wide.cast("decimal(38,0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_bars(
    ticks: DataFrame, price: Column, size: Column, order: Column, spread: Column
) -> DataFrame:
    """OHLC bars of ticks that carry ``symbol`` and an interval ``ts`` (any cheap code of it)."""
    return (
        ticks.select("symbol", "ts", price.alias("p"), size.alias("q"), order.alias("k"), spread.alias("s"))
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("p", "k").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "k").alias("close"),
            F.sum("q").alias("volume"),
            (F.sum(F.col("p") * F.col("q")) / F.nullif(F.sum("q"), F.lit(0.0))).alias("wap"),
            F.count("*").alias("trade_count"),
            F.max_by("s", "k").alias("quoted_spread"),
        )
    )


def fill_spread(bars: DataFrame) -> DataFrame:
    """Non-positive quoted spreads are missing; take the last valid one, else the next."""
    w = Window.partitionBy("symbol").orderBy("ts")
    valid = F.when(F.col("quoted_spread") > 0, F.col("quoted_spread"))
    back = F.last(valid, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Only bars before the first valid spread look ahead, and they all see that one.
    ahead = F.first(valid, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumn("fill_spread_fraction", F.coalesce(back, ahead)).drop("quoted_spread")


def hourly_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events`` per event type, spread still as quoted."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ticks = e.select(
        F.col("event_type").alias("symbol"),
        F.expr("unix_micros(ts) div 3600000000").alias("ts"),
        "value",
        order_key(F.unix_micros("ts"), F.col("event_id")).alias("ord"),
        (F.get_json_object("props", "$.k").cast("double") / 1e5).alias("spr"),
    )
    bars = build_bars(ticks, 100 + F.col("value") / 10, F.col("value"), F.col("ord"), F.col("spr"))
    return bars.withColumn("ts", F.timestamp_seconds(F.col("ts") * 3600))


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``lineitem`` per return flag, spread still as quoted."""
    li = table(spark, sf_dir, "lineitem")
    ticks = li.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("ts"),
        "l_extendedprice",
        "l_quantity",
        order_key(
            F.col("l_orderkey") * 1000 + F.col("l_linenumber"),
            F.round(F.col("l_extendedprice") * 100).cast("long") * 1000 + F.round(F.col("l_tax") * 100).cast("long"),
        ).alias("ord"),
        (F.col("l_tax") / 100).alias("spr"),
    )
    bars = build_bars(
        ticks, 100 + F.col("l_extendedprice") / 2500, F.col("l_quantity"), F.col("ord"), F.col("spr")
    )
    return bars.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_spread(hourly_raw(spark, sf_dir))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_spread(daily_raw(spark, sf_dir))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series per region and kind, plus one daily global series ``GAUGE``.

    Regions act as currencies: ``policy``, ``inflation`` and ``yield`` are three monthly
    averages of the region's orders.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    day = F.col("o_orderdate").cast("timestamp")
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    monthly = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("currency"), F.date_trunc("month", day).alias("date"))
        .agg(
            F.avg("o_totalprice").alias("a"),
            F.avg("c_acctbal").alias("b"),
            F.avg(F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice"))).alias("y"),
        )
        .select(
            "currency",
            "date",
            F.explode(
                F.array(
                    F.struct(F.lit("policy").alias("kind"), (F.col("a") / 1e5).alias("value")),
                    F.struct(F.lit("inflation").alias("kind"), (F.col("b") / 5e3).alias("value")),
                    F.struct(F.lit("yield").alias("kind"), (F.col("y") / 1e5).alias("value")),
                )
            ).alias("s"),
        )
        .select(F.concat_ws("_", F.col("s.kind"), "currency").alias("series_id"), "date", F.col("s.value").alias("value"))
    )
    gauge = (
        o.groupBy(F.date_trunc("day", day).alias("date"))
        .agg((F.avg("o_totalprice") / 350).alias("value"))
        .select(F.lit("GAUGE").alias("series_id"), "date", "value")
    )
    return monthly.unionByName(gauge).filter(F.col("value").isNotNull())
