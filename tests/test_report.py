"""Printed figures of the reports."""

import duckdb

from pyspark.sql import functions as F

import check
from tidebars.catalog import reports
from tidebars.catalog.base import ORACLES, QUERIES
from tidebars.plans import report

TIES = (-4.95, 0.05, 0.25, 0.35, 1.005, 0.0005, 1.0005, 1.2605, 1.1005, -31.15, 2.675, -0.04, -1e-12, 0.0, 12500000.1255, 1e15)


def test_ties_print_as_in_c(spark):
    df = spark.createDataFrame([(float(v),) for v in TIES], "v double")
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.select(report.printed(F.col("v"), d)).collect()]
        assert got == [f"{v + 0.0:.{d}f}" if v != -1e-12 else f"{0:.{d}f}" for v in TIES]
    noisy = spark.createDataFrame([(1.2605 + 4e-16,), (1.2605,), (1.2605 - 4e-16,)], "v double")
    assert len({r[0] for r in noisy.select(report.printed(F.col("v"), 3)).collect()}) == 1
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(report.percent("v")).collect()[0][0] == ""


def write(spark, folder, prices):
    """One customer per list of prices."""
    orders = [(i, p) for i, row in enumerate(prices, 1) for p in row]
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    customers = [(i, "BUILDING", 0, 10.0) for i in range(1, len(prices) + 1)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "CHINA")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")


def run(spark, folder):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES["survivor_table"](spark, str(folder)).toPandas()
    return got, con.execute(ORACLES["survivor_table"]).fetchdf()


def test_survivor_table_ties_match_sql(spark, tmp_path):
    """Drawdowns and means halfway between two shown figures, equal prices (no Sharpe)."""
    tie = [100000.0, 411500.0, 326050.0, 326050.0, 326050.0, 326050.0]  # drawdown of -31.15 %
    mean = [(326050.0 + d) for d in (0, 100, -100, 200, -200, 0)]  # oos of 1.2605
    write(spark, tmp_path, [tie, mean, [250001.0] * 6, [326050.0 + d for d in (0.1, 0.2, 0.3, -0.1, -0.2, -0.3)]])
    got, want = run(spark, tmp_path)
    assert len(got) > 0 and check.compare(got, want) == ""


def test_survivor_table_without_survivors_matches_sql(spark, tmp_path):
    write(spark, tmp_path, [[1.0, 2.0]])
    got, want = run(spark, tmp_path)
    assert got.result.tolist() == ["No candidate passed all four validation layers."] and check.compare(got, want) == ""
    assert list(reports.SHOWN) == [c for c in want.columns if c not in ("result", "candidate_id")]
