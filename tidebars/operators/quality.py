"""Row-level quality flags, cleaning and per-symbol quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

PRICES = ("open", "high", "low", "close")
FRIDAY = 4
USUAL_GAP_MINUTES, WEEKEND_GAP_MINUTES = 90.0, 52 * 60.0
EXTREME_RETURN = EXTREME_RANGE = 0.02

# The instrument dimension of the test tables.
INSTRUMENTS = [
    ("click", "CASH", "EUR", "IDEALPRO", "MIDPOINT", "24/5"),
    ("error", "CASH", "USD", "IDEALPRO", "MIDPOINT", "24/7"),
    ("purchase", "STK", "EUR", "IBIS", "TRADES", "broker_rth"),
    ("signup", "CMDTY", "USD", "SMART", "MIDPOINT", "24/5"),
    ("view", "STK", "GBP", "LSE", "TRADES", "24/7"),
    ("A", "CASH", "USD", "IDEALPRO", "MIDPOINT", "24/5"),
    ("N", "CASH", "JPY", "IDEALPRO", "MIDPOINT", "24/5"),
    ("R", "STK", "GBP", "LSE", "TRADES", "24/7"),
]


def instruments(spark: SparkSession) -> DataFrame:
    return F.broadcast(
        spark.createDataFrame(
            INSTRUMENTS,
            "symbol string, sec_type string, currency string, exchange string, what_to_show string, expected_session string",
        )
    )


def _true(cond: Column) -> Column:
    """Comparisons with a missing value count as not met."""
    return F.coalesce(cond, F.lit(False))


def _any(*conds: Column) -> Column:
    out = F.lit(False)
    for cond in conds:
        out = out | _true(cond)
    return out


def with_previous(rows: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Add the time and close of the row before, per symbol in (ts, seq) order.

    Two levels: inside a day by window, and across days through one summary row per
    (symbol, day), so a heavy symbol is spread over its days.
    """
    day = F.date_trunc("day", "ts")
    df = rows.withColumn("_day", F.coalesce(day, F.lit("1900-01-01").cast("timestamp")))
    inside = Window.partitionBy("symbol", "_day").orderBy("ts", seq)
    last = df.groupBy("symbol", "_day").agg(F.max(F.struct("ts", seq, "close")).alias("z"), F.count("*").alias("_n"))
    across = Window.partitionBy("symbol").orderBy("_day")
    last = last.select(
        "symbol", "_day", F.lag("z.ts").over(across).alias("_lt"), F.lag("z.close").over(across).alias("_lc")
    )
    df = df.withColumns(
        {"_r": F.row_number().over(inside), "_pt": F.lag("ts").over(inside), "_pc": F.lag("close").over(inside)}
    ).join(last, ["symbol", "_day"])
    pick = lambda near, far: F.when(F.col("_r") == 1, F.col(far)).otherwise(F.col(near))
    return df.withColumns({"prev_ts": pick("_pt", "_lt"), "prev_close": pick("_pc", "_lc")}).drop(
        "_day", "_r", "_pt", "_pc", "_lt", "_lc"
    )


def row_flags(rows: DataFrame) -> DataFrame:
    """Mechanical flags; every copy of a repeated timestamp is a duplicate."""
    copies = rows.groupBy(F.col("symbol").alias("_s"), F.col("ts").alias("_t")).agg(F.count("*").alias("_copies")).filter("_copies > 1")
    flagged = rows.join(copies, (F.col("symbol") == F.col("_s")) & F.col("ts").eqNullSafe(F.col("_t")), "left")
    c = F.col
    return flagged.withColumns(
        {
            "invalid_timestamp": c("ts").isNull(),
            "duplicate_timestamp": c("_copies").isNotNull(),
            "missing_required_value": _any(*[c(x).isNull() for x in ("ts", *PRICES)]),
            "nonpositive_price": _any(*[c(x) <= 0 for x in PRICES]),
            "high_below_low": _true(c("high") < c("low")),
            "open_outside_range": _any(c("open") < c("low"), c("open") > c("high")),
            "close_outside_range": _any(c("close") < c("low"), c("close") > c("high")),
        }
    ).drop("_s", "_t", "_copies")


def gap_flags(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Minutes since the row before, against a ceiling that allows for weekends."""
    df = with_previous(rows).join(dimension.select("symbol", "expected_session"), "symbol", "left")
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 6e7
    ceiling = F.when(
        (F.col("expected_session") != "24/7") & (F.weekday("prev_ts") == FRIDAY), WEEKEND_GAP_MINUTES
    ).otherwise(USUAL_GAP_MINUTES)
    return df.withColumn("time_gap_minutes", gap).withColumn("unexpected_gap", _true(F.col("time_gap_minutes") > ceiling))


def extreme_flags(rows: DataFrame) -> DataFrame:
    """Close return (not across unexpected gaps) and bar range, with diagnostic flags."""
    c = F.col
    change = c("close") / F.nullif(c("prev_close"), F.lit(0.0)) - 1
    df = rows.withColumns(
        {
            "close_return": F.when(~c("unexpected_gap"), change),
            "bar_range_fraction": (c("high") - c("low")) / F.nullif(c("close"), F.lit(0.0)),
        }
    )
    return df.withColumns(
        {
            "extreme_return": _true(F.abs("close_return") > EXTREME_RETURN),
            "extreme_range": _true(c("bar_range_fraction") > EXTREME_RANGE),
        }
    )


def all_flags(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    return extreme_flags(gap_flags(row_flags(rows), dimension))


def invalid(flags: DataFrame) -> Column:
    names = ("invalid_timestamp", "missing_required_value", "nonpositive_price", "high_below_low", "open_outside_range", "close_outside_range")
    return _any(*[flags[n] for n in names])


def keep_last(rows: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), seq: str = "ingest_seq") -> DataFrame:
    """The row of each key that arrived last.

    An aggregate rather than a ranked window: copies are reduced before the shuffle, so
    a key with a third of all rows costs one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_z"), F.count("*").alias("_copies"))
    return picked.select(*keys, *[F.col("_z")[c].alias(c) for c in rest], "_copies")


def clean(flagged: DataFrame) -> DataFrame:
    """Mechanically valid rows, one per timestamp."""
    return keep_last(flagged.filter(~invalid(flagged))).drop("_copies")


def cleaning_counts(flagged: DataFrame) -> DataFrame:
    """Invalid rows removed first; duplicates counted on what remains.

    Counts are taken per (symbol, ts) and then added up, both with map-side partials.
    """
    valid = ~invalid(flagged)
    per_key = flagged.groupBy("symbol", "ts").agg(F.count_if(valid).alias("ok"), F.count_if(~valid).alias("bad"))
    return per_key.groupBy("symbol").agg(
        F.sum("bad").alias("removed_invalid_rows"),
        F.sum(F.when(F.col("ok") > 1, F.col("ok")).otherwise(0)).alias("duplicate_rows_identified"),
        F.count_if(F.col("ok") > 0).alias("rows_after_cleaning"),
    )


def report(flagged: DataFrame) -> DataFrame:
    c = F.col
    return flagged.groupBy("symbol").agg(
        F.count("*").alias("row_count"),
        F.min("ts").alias("start_timestamp"),
        F.max("ts").alias("end_timestamp"),
        F.count_if("invalid_timestamp").alias("invalid_timestamp_count"),
        F.count_if("duplicate_timestamp").alias("duplicate_timestamp_rows"),
        F.count_if("missing_required_value").alias("missing_required_value_count"),
        F.count_if("nonpositive_price").alias("nonpositive_price_count"),
        F.count_if(c("high_below_low") | c("open_outside_range") | c("close_outside_range")).alias("invalid_ohlc_count"),
        F.count_if("extreme_return").alias("extreme_return_count"),
        F.count_if("extreme_range").alias("extreme_range_count"),
        F.count_if("unexpected_gap").alias("unexpected_gap_count"),
        F.max("time_gap_minutes").alias("largest_time_gap_minutes"),
    )


def market_summary(reports: DataFrame, dimension: DataFrame) -> DataFrame:
    return reports.join(dimension.select("symbol", "currency", "exchange"), "symbol", "left")
