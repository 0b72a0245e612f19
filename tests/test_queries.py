"""Every kind of query against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "bars_hourly", "bars_daily", "macro_series", "dq_pipeline", "dq_extremes", "incremental_topup", "asof_rate_diff", "pair_bars",
    "cointegration_screen", "ema", "macd", "adx", "rsi", "squeeze", "rolling_corr", "psar", "sig_trend", "sig_mr_keltner", "sig_vol_mr",
    "sig_carry_risk", "trades", "nav_drawdown", "return_metrics", "param_neighbors", "candidate_population", "cooldown_due", "l1_gate", "wf_slice",
    "l2_gate", "l3_gate", "perm_test", "trade_bootstrap", "failure_summary", "validation_export", "sharpe_histogram", "stream_bars", "stream_session",
    "stream_dedup", "stream_signal",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert check.compare(got, want) == ""


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 9
