"""Slow series carried forward onto bars (as-of backward joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tidebars.sources.ticks import CURRENCY_LEGS


def asof_join(bars: DataFrame, facts: DataFrame, values: tuple[str, ...], key: str = "symbol") -> DataFrame:
    """Attach to each bar the last non-null value of every fact dated at or before it.

    Both sides are laid into one ordered stream per key (facts first on equal times), so
    any number of series costs one shuffle and no range join.
    """
    width = [F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in bars.columns if c not in (key, "ts")]
    side = facts.select(key, F.col("date").alias("ts"), *width, *values, F.lit(0).alias("_side"))
    main = bars.select("*", *[F.lit(None).cast("double").alias(v) for v in values], F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = main.unionByName(side)
    both = both.withColumns({v: F.last(v, True).over(w) for v in values})
    return both.filter(F.col("_side") == 1).drop("_side")


def legs(spark: SparkSession) -> DataFrame:
    """Base and quote currency of each symbol (a small dimension)."""
    rows = [(s, b, q) for s, (b, q) in CURRENCY_LEGS.items()]
    return F.broadcast(spark.createDataFrame(rows, "symbol string, base string, quote string"))


def series_routing(macro: DataFrame) -> DataFrame:
    """Series id to the currency and kind it serves; the global gauge has no currency."""
    parts = F.split("series_id", "_", 2)
    keyed = F.col("series_id").contains("_")
    return macro.select(
        "series_id",
        F.when(keyed, parts[0]).otherwise("gauge").alias("kind"),
        F.when(keyed, F.element_at(parts, 2)).alias("currency"),
        "date",
        "value",
    )


def currency_table(macro: DataFrame) -> DataFrame:
    """One row per currency and date with the three series side by side."""
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
    return (
        series_routing(macro)
        .filter(F.col("currency").isNotNull())
        .groupBy("currency", "date")
        .agg(pick("policy"), pick("inflation"), pick("yield"))
    )


def differentials(macro: DataFrame) -> DataFrame:
    """Base-minus-quote differentials per symbol on the dates both legs report."""
    spark = macro.sparkSession
    cur = currency_table(macro)
    side = lambda s: legs(spark).join(
        cur.select(F.col("currency").alias(s), "date", *[F.col(k).alias(f"{s}_{k}") for k in ("policy", "inflation", "yield")]), s
    ).select("symbol", "date", *[f"{s}_{k}" for k in ("policy", "inflation", "yield")])
    both = side("base").join(side("quote"), ["symbol", "date"])
    b = lambda k: F.col(f"base_{k}")
    q = lambda k: F.col(f"quote_{k}")
    return both.select(
        "symbol",
        "date",
        (b("policy") - q("policy")).alias("interest_rate_differential"),
        ((b("policy") - b("inflation")) - (q("policy") - q("inflation"))).alias("real_rate_differential"),
        ((b("yield") - b("policy")) - (q("yield") - q("policy"))).alias("term_slope_differential"),
    )


def with_gauge(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Attach the global daily series: carried forward once over the calendar, then joined by day.

    The calendar (days that have bars or a value, of all symbols together) is the only
    thing ordered as a whole; a century of it is 36 500 rows.
    """
    day = F.date_trunc("day", F.col("ts"))
    value = macro.filter(F.col("series_id") == "GAUGE").groupBy(F.date_trunc("day", "date").alias("_day")).agg(F.max_by("value", "date").alias("vix_level"))
    days = bars.select(day.alias("_day")).distinct().withColumn("_asked", F.lit(True))
    w = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(value, "_day", "full_outer").withColumn("vix_level", F.last("vix_level", True).over(w)).filter("_asked").drop("_asked")
    return bars.withColumn("_day", day).join(filled, "_day", "left").drop("_day")


DIFFERENTIALS = ("interest_rate_differential", "real_rate_differential", "term_slope_differential")


def enrich(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """All macro columns at once."""
    return with_gauge(asof_join(bars, differentials(macro), DIFFERENTIALS), macro)
