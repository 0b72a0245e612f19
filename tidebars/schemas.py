"""Table schemas shared by sources, operators and tests."""

from pyspark.sql import types as T

_D, _S, _TS = T.DoubleType(), T.StringType(), T.TimestampType()

OPTIONAL_BAR_COLUMNS = (
    "leg_a_close",
    "leg_b_close",
    "interest_rate_differential",
    "real_rate_differential",
    "term_slope_differential",
    "vix_level",
)

BARS = T.StructType(
    [T.StructField("symbol", _S), T.StructField("ts", _TS)]
    + [T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume", "wap")]
    + [T.StructField("trade_count", T.LongType()), T.StructField("fill_spread_fraction", _D)]
)

MACRO = T.StructType(
    [T.StructField("series_id", _S), T.StructField("date", _TS), T.StructField("value", _D)]
)

TEST_EVENTS = T.StructType(
    [
        T.StructField("candidate_id", _S),
        T.StructField("run_id", _S),
        T.StructField("family", _S),
        T.StructField("symbol", _S),
        T.StructField("tested_at", _TS),
    ]
    + [T.StructField(f"layer{i}_pass", T.BooleanType()) for i in (1, 2, 3, 4)]
    + [
        T.StructField("final_pass", T.BooleanType()),
        T.StructField("status", _S),
        T.StructField("error_message", _S),
    ]
)
