"""Bar construction and keyed maintenance of bar tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import cte, dbl, query
from tidebars.operators import quality
from tidebars.session import materialize, shared_folder
from tidebars.sources import store, ticks

NUM = ("open", "high", "low", "close", "volume", "wap", "fill_spread_fraction")


@query("bars_hourly", f"SELECT symbol, ts, trade_count, {dbl(*NUM)} FROM bars_h")
def bars_hourly(spark, d):
    return ticks.hourly_bars(spark, d).select("symbol", "ts", "trade_count", *NUM)


@query("bars_daily", f"SELECT symbol, ts, trade_count, {dbl(*NUM)} FROM bars_d")
def bars_daily(spark, d):
    return ticks.daily_bars(spark, d).select("symbol", "ts", "trade_count", *NUM)


@query("macro_series", f"SELECT series_id, date, {dbl('value')} FROM macro")
def macro_series(spark, d):
    return ticks.macro(spark, d)


# --- stored bars ---------------------------------------------------------------------
BAR_SELECT = f"symbol, ts, trade_count, {dbl(*NUM)}"


def bar_schema(*extra: str):
    return ["symbol", "ts", "trade_count", *NUM, *extra]


@query("scan_bars", f"SELECT {BAR_SELECT} FROM bars_h WHERE symbol IN ('click', 'view')")
def scan_bars(spark, d):
    path = shared_folder(spark, "bars")
    store.write_bars(ticks.hourly_bars(spark, d), path)
    return store.scan_bars(spark, path, ["click", "view"]).select(*bar_schema())


@query("sink_bars_roundtrip", f"SELECT {BAR_SELECT} FROM bars_d")
def sink_bars_roundtrip(spark, d):
    path = shared_folder(spark, "bars")
    store.write_bars(ticks.daily_bars(spark, d), path)
    return store.scan_bars(spark, path).select(*bar_schema())


@query(
    "decode_json_series",
    """SELECT event_type AS series_id, date_trunc('day', ts) AS date, round(k + 3.7e-8, 6) + 0.0 AS value
FROM (SELECT event_type, ts, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k FROM events) WHERE k % 10 <> 0""",
)
def decode_json_series(spark, d):
    e = ticks.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    value = F.when(k.cast("int") % 10 == 0, F.lit(".")).otherwise(k)
    payload = F.to_json(F.struct(F.array(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations")))
    return store.decode_series(e.select(F.col("event_type").alias("series_id"), payload.alias("payload")))


@query(
    "epoch_normalize",
    """SELECT symbol, ts, event_id, round(value + 3.7e-8, 6) + 0.0 AS value FROM (
  SELECT event_type AS symbol, date_trunc('second', ts) AS ts, event_id, value,
    row_number() OVER (PARTITION BY event_type, date_trunc('second', ts) ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def epoch_normalize(spark, d):
    e = ticks.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
        "event_id",
        "value",
        F.col("event_id").alias("ingest_seq"),
    )
    return store.epoch_to_timestamp(e).select("symbol", "ts", "event_id", "value")


# Bars of one hour fall together; the one with the largest id stays.
@query(
    "dedup_keep_last",
    """SELECT symbol, ts, event_id, round(value + 3.7e-8, 6) + 0.0 AS value FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, event_id, value,
    row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def dedup_keep_last(spark, d):
    e = ticks.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").alias("ts"),
        "event_id",
        "value",
        F.col("event_id").alias("ingest_seq"),
    )
    return quality.keep_last(e).select("symbol", "ts", "event_id", "value")


CHUNK_A, CHUNK_B, FLOOR = "2024-01-12", "2024-01-10", "2024-01-03 06:00:00"


@query(
    "stitch_chunks",
    f"""SELECT symbol, ts, {dbl('close')} FROM (
SELECT symbol, ts, close FROM bars_h WHERE ts >= TIMESTAMP '{CHUNK_B}'
UNION ALL SELECT symbol, ts, close + 1 FROM bars_h WHERE ts < TIMESTAMP '{CHUNK_A}' AND ts < TIMESTAMP '{CHUNK_B}'
) WHERE ts >= TIMESTAMP '{FLOOR}'""",
)
def stitch_chunks(spark, d):
    bars = ticks.hourly_bars(spark, d).select("symbol", "ts", "close")
    older = bars.filter(F.col("ts") < CHUNK_A).withColumn("close", F.col("close") + 1)
    newer = bars.filter(F.col("ts") >= CHUNK_B)
    return store.stitch([older, newer], F.lit(FLOOR).cast("timestamp"))


@query(
    "incremental_topup",
    f"""SELECT symbol, ts, {dbl('close')} FROM (
SELECT s.symbol, s.ts, coalesce(i.close + 1, s.close) AS close FROM bars_h s
  JOIN (SELECT symbol, max(ts) AS last FROM bars_h WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) m USING (symbol)
  LEFT JOIN bars_h i ON i.symbol = s.symbol AND i.ts = s.ts AND i.ts >= last - INTERVAL 72 HOUR
WHERE s.ts < TIMESTAMP '2024-01-20'
UNION ALL SELECT symbol, ts, close + 1 FROM bars_h WHERE ts >= TIMESTAMP '2024-01-20')""",
)
def incremental_topup(spark, d):
    bars = materialize(ticks.hourly_bars(spark, d).select("symbol", "ts", "close"), "bars")
    path = shared_folder(spark, "stored")
    store.write_bars(bars.filter(F.col("ts") < "2024-01-20"), path)
    store.top_up_stored(spark, path, bars.withColumn("close", F.col("close") + 1), F.lit("2024-01-01").cast("timestamp"))
    return store.scan_bars(spark, path, schema=bars.schema)


@query(
    "join_price_spread",
    f"SELECT symbol, ts, {dbl('close', 'fill_spread_fraction')} FROM bars_h",
)
def join_price_spread(spark, d):
    bars = materialize(ticks.hourly_bars(spark, d), "bars")
    spreads = bars.select("symbol", "ts", "fill_spread_fraction")
    return store.join_price_spread(bars.select("symbol", "ts", "close"), spreads)


@query("fill_spread", f"SELECT symbol, ts, {dbl('quoted_spread', 'fill_spread_fraction')} FROM bars_h_raw JOIN bars_h USING (symbol, ts)")
def fill_spread(spark, d):
    raw = ticks.hourly_raw(spark, d)
    kept = ticks.fill_spread(raw.withColumn("q", F.col("quoted_spread")))
    return kept.select("symbol", "ts", F.col("q").alias("quoted_spread"), "fill_spread_fraction")


@query(
    "upsert_by_key",
    """SELECT 'c' || c_custkey AS candidate_id, round(CASE WHEN n IS NULL THEN c_acctbal ELSE total END + 3.7e-8, 6) + 0.0 AS metric, n AS orders
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
ON o_custkey = c_custkey""",
)
def upsert_by_key(spark, d):
    cid = lambda c: F.concat(F.lit("c"), F.col(c)).alias("candidate_id")
    existing = ticks.table(spark, d, "customer").select(cid("c_custkey"), F.col("c_acctbal").alias("metric"))
    new = (
        ticks.table(spark, d, "orders")
        .filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
        .groupBy("o_custkey")
        .agg(F.sum("o_totalprice").alias("metric"), F.count("*").alias("orders"))
        .select(cid("o_custkey"), "metric", "orders")
    )
    return store.upsert(existing, new)


EVENTS_SQL = """SELECT 'c' || o_custkey AS candidate_id, 'run' || (o_orderkey % 7) AS run_id, o_orderpriority AS family,
  o_orderstatus AS symbol, o_orderdate AS tested_at, o_totalprice > 300000 AS final_pass,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders"""


def event_rows(spark, d):
    """Test events derived from orders: a customer is a candidate, an order a test."""
    o = ticks.table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("c"), "o_custkey").alias("candidate_id"),
        F.concat(F.lit("run"), F.col("o_orderkey") % 7).alias("run_id"),
        F.col("o_orderpriority").alias("family"),
        F.col("o_orderstatus").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("tested_at"),
        (F.col("o_totalprice") > 300000).alias("final_pass"),
        F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("completed").alias("status"),
    )


cte("test_log", EVENTS_SQL)


@query("append_events", "SELECT * FROM test_log")
def append_events(spark, d):
    path = shared_folder(spark, "events")
    rows = event_rows(spark, d)
    early = F.col("tested_at") < "1998-01-01"
    store.append_events(rows.filter(early), path)
    store.append_events(rows.filter(~early), path)
    return spark.read.schema(rows.schema).parquet(path)


# --- quality -------------------------------------------------------------------------
cte(
    "dirty",
    """SELECT symbol, ts, open, CASE WHEN u % 11 = 0 THEN low - 0.5 ELSE high END AS high,
  CASE WHEN u % 19 = 0 THEN 0.0 ELSE low END AS low,
  CASE WHEN u % 13 = 0 THEN 0.0 WHEN u % 17 = 0 THEN NULL ELSE close END AS close, 1 AS ingest_seq
FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS u FROM bars_h) WHERE u % 53 > 3
UNION ALL SELECT symbol, ts, open, high, low, close, 2 FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS u FROM bars_h) WHERE u % 7 = 0
UNION ALL SELECT symbol, NULL, open, high, low, close, 3 + u FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS u FROM bars_h) WHERE u % 97 = 0""",
)


def dirty(spark, d):
    """Hourly bars with swapped, zero, missing, repeated, undated and absent rows."""
    bars = materialize(ticks.hourly_bars(spark, d).select("symbol", "ts", *quality.PRICES), "bars")
    b = bars.withColumn("u", F.floor(F.unix_seconds("ts") / 3600))
    u = F.col("u")
    cols = ["symbol", "ts", *quality.PRICES, "ingest_seq"]
    main = b.filter(u % 53 > 3).withColumns(
        {
            "high": F.when(u % 11 == 0, F.col("low") - 0.5).otherwise(F.col("high")),
            "low": F.when(u % 19 == 0, 0.0).otherwise(F.col("low")),
            "close": F.when(u % 13 == 0, 0.0).when(u % 17 == 0, None).otherwise(F.col("close")),
            "ingest_seq": F.lit(1).cast("long"),
        }
    )
    again = b.filter(u % 7 == 0).withColumn("ingest_seq", F.lit(2).cast("long"))
    undated = b.filter(u % 97 == 0).withColumns({"ts": F.lit(None).cast("timestamp"), "ingest_seq": u + 3})
    return main.select(*cols).unionByName(again.select(*cols)).unionByName(undated.select(*cols))


cte("dimension", "SELECT * FROM (VALUES " + ", ".join(str(t) for t in quality.INSTRUMENTS) + ") t(symbol, sec_type, currency, exchange, what_to_show, expected_session)")
cte(
    "flag1",
    """SELECT *, ts IS NULL AS invalid_timestamp, count(*) OVER (PARTITION BY symbol, ts) > 1 AS duplicate_timestamp,
  ts IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL AS missing_required_value,
  coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false) AS nonpositive_price,
  coalesce(high < low, false) AS high_below_low,
  coalesce(open < low, false) OR coalesce(open > high, false) AS open_outside_range,
  coalesce(close < low, false) OR coalesce(close > high, false) AS close_outside_range,
  lag(ts) OVER w AS prev_ts, lag(close) OVER w AS prev_close
FROM dirty WINDOW w AS (PARTITION BY symbol ORDER BY ts NULLS FIRST, ingest_seq)""",
)
cte(
    "flag2",
    """SELECT *, coalesce(time_gap_minutes > CASE WHEN expected_session <> '24/7' AND isodow(prev_ts) = 5 THEN 3120.0 ELSE 90.0 END, false) AS unexpected_gap
FROM (SELECT f.*, expected_session, (epoch_us(ts) - epoch_us(prev_ts)) / 6e7 AS time_gap_minutes FROM flag1 f LEFT JOIN dimension USING (symbol))""",
)
cte(
    "flag3",
    """SELECT *, coalesce(abs(close_return) > 0.02, false) AS extreme_return, coalesce(bar_range_fraction > 0.02, false) AS extreme_range
FROM (SELECT *, CASE WHEN NOT unexpected_gap THEN close / nullif(prev_close, 0) - 1 END AS close_return,
  (high - low) / nullif(close, 0) AS bar_range_fraction FROM flag2)""",
)
cte(
    "flags_ok",
    """SELECT *, invalid_timestamp OR missing_required_value OR nonpositive_price OR high_below_low OR open_outside_range OR close_outside_range AS bad FROM flag3""",
)
FLAG_NAMES = ("invalid_timestamp", "duplicate_timestamp", "missing_required_value", "nonpositive_price", "high_below_low", "open_outside_range", "close_outside_range")


@query("dq_flags", f"SELECT symbol, ts, ingest_seq, {', '.join(FLAG_NAMES)} FROM flag1")
def dq_flags(spark, d):
    return quality.row_flags(dirty(spark, d)).select("symbol", "ts", "ingest_seq", *FLAG_NAMES)


@query("dq_gaps", f"SELECT symbol, ts, ingest_seq, {dbl('time_gap_minutes')}, unexpected_gap FROM flag2")
def dq_gaps(spark, d):
    return quality.gap_flags(dirty(spark, d), quality.instruments(spark)).select("symbol", "ts", "ingest_seq", "time_gap_minutes", "unexpected_gap")


@query("dq_extremes", f"SELECT symbol, ts, ingest_seq, {dbl('close_return', 'bar_range_fraction')}, extreme_return, extreme_range FROM flag3")
def dq_extremes(spark, d):
    return quality.all_flags(dirty(spark, d), quality.instruments(spark)).select(
        "symbol", "ts", "ingest_seq", "close_return", "bar_range_fraction", "extreme_return", "extreme_range"
    )


CLEAN_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq DESC) AS r FROM flags_ok WHERE NOT bad) WHERE r = 1"""
cte("cleaned", CLEAN_SQL)


@query("dq_clean", f"SELECT symbol, ts, ingest_seq, {dbl(*quality.PRICES)} FROM cleaned")
def dq_clean(spark, d):
    return quality.clean(quality.row_flags(dirty(spark, d))).select("symbol", "ts", "ingest_seq", *quality.PRICES)


cte(
    "dq_reports",
    """SELECT symbol, count(*) AS row_count, min(ts) AS start_timestamp, max(ts) AS end_timestamp,
  count_if(invalid_timestamp) AS invalid_timestamp_count, count_if(duplicate_timestamp) AS duplicate_timestamp_rows,
  count_if(missing_required_value) AS missing_required_value_count, count_if(nonpositive_price) AS nonpositive_price_count,
  count_if(high_below_low OR open_outside_range OR close_outside_range) AS invalid_ohlc_count,
  count_if(extreme_return) AS extreme_return_count, count_if(extreme_range) AS extreme_range_count,
  count_if(unexpected_gap) AS unexpected_gap_count, max(time_gap_minutes) AS largest_time_gap_minutes
FROM flag3 GROUP BY symbol""",
)
REPORT_COUNTS = (
    "row_count", "invalid_timestamp_count", "duplicate_timestamp_rows", "missing_required_value_count", "nonpositive_price_count",
    "invalid_ohlc_count", "extreme_return_count", "extreme_range_count", "unexpected_gap_count",
)
REPORT_SELECT = f"symbol, start_timestamp, end_timestamp, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in REPORT_COUNTS)}, {dbl('largest_time_gap_minutes')}"


@query("dq_report", f"SELECT {REPORT_SELECT} FROM dq_reports")
def dq_report(spark, d):
    return quality.report(quality.all_flags(dirty(spark, d), quality.instruments(spark)))


cte(
    "cleaning",
    """SELECT symbol, sum(bad_n) AS removed_invalid_rows, sum(CASE WHEN ok_n > 1 THEN ok_n ELSE 0 END) AS duplicate_rows_identified,
  count_if(ok_n > 0) AS rows_after_cleaning FROM (
  SELECT symbol, ts, count_if(bad) AS bad_n, count_if(NOT bad) AS ok_n FROM flags_ok GROUP BY 1, 2) GROUP BY 1""",
)
CLEANING = ("removed_invalid_rows", "duplicate_rows_identified", "rows_after_cleaning")


@query("dq_pipeline", f"SELECT {REPORT_SELECT}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in CLEANING)} FROM dq_reports JOIN cleaning USING (symbol)")
def dq_pipeline(spark, d):
    flagged = materialize(quality.all_flags(dirty(spark, d), quality.instruments(spark)), "flags")
    return quality.report(flagged).join(quality.cleaning_counts(flagged), "symbol")


@query("market_summary", f"SELECT {REPORT_SELECT}, currency, exchange FROM dq_reports LEFT JOIN dimension USING (symbol)")
def market_summary(spark, d):
    return quality.market_summary(dq_report(spark, d), quality.instruments(spark))


@query("report_json", f"SELECT {REPORT_SELECT} FROM dq_reports")
def report_json(spark, d):
    path = shared_folder(spark, "report")
    rows = quality.report(quality.all_flags(dirty(spark, d), quality.instruments(spark)))
    store.write_reports(rows, path)
    return spark.read.schema(rows.schema).json(path)
