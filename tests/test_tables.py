import pandas as pd
from pyspark.sql import functions as F

from tidebars.operators.quality import keep_last
from tidebars.session import require_columns
from tidebars.sources import store

import pytest


def frame(spark, rows):
    return spark.createDataFrame(rows, "candidate_id string, metric double")


def test_upsert_of_parts_equals_upsert_of_union(spark):
    old = frame(spark, [(f"c{i}", float(i)) for i in range(10)])
    a = frame(spark, [("c1", 100.0), ("c11", 11.0)])
    b = frame(spark, [("c3", 300.0), ("c12", 12.0)])
    want = sorted(store.upsert(old, a.unionByName(b)).collect())
    assert sorted(store.upsert(store.upsert(old, a), b).collect()) == want
    assert sorted(store.upsert(store.upsert(old, b), a).collect()) == want


def test_keep_last_survives_one_hot_key(spark):
    hot = spark.range(50000).select(
        F.lit("S").alias("symbol"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("timestamp").alias("ts"),
        F.col("id").alias("ingest_seq"), (F.col("id") * 2).alias("v"),
    )
    got = keep_last(hot).filter(F.col("ts") == F.lit(0).cast("timestamp")).collect()
    assert len(got) == 1 and got[0].ingest_seq == 49998 and got[0].v == 99996


def test_top_up_replaces_the_overlap_only(spark):
    ts = pd.date_range("2024-01-01", periods=200, freq="h")
    stored = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": ts, "close": 1.0}))
    incoming = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": ts + pd.Timedelta(hours=50), "close": 2.0}))
    out = store.top_up(stored, incoming, F.lit("2023-01-01").cast("timestamp")).toPandas()
    assert len(out) == 250
    assert (out["close"] == 2.0).sum() == 73 + 50


def test_required_columns(spark):
    with pytest.raises(ValueError, match="close"):
        require_columns(spark.range(1), "id", "close")


def test_symbol_folders_are_pruned(spark, ohlc):
    from tidebars.session import shared_folder

    path = shared_folder(spark, "prune")
    both = pd.concat([ohlc.head(50), ohlc.head(50).assign(symbol="Y")])
    rows = spark.createDataFrame(both).withColumns({"wap": F.col("close"), "trade_count": F.lit(1).cast("long")})
    store.write_bars(rows, path)
    got = store.scan_bars(spark, path, ["Y"])
    assert got.count() == 50
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    assert "(symbol" in store.scan_bars(spark, path, ["Y"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_top_up_rewrites_only_the_months_it_touches(spark, tmp_path):
    """Months before the overlap keep their files; symbols that are new are added."""
    days = pd.date_range("2024-01-01", periods=100, freq="D")
    rows = pd.DataFrame({"symbol": "X", "ts": days, "close": 1.0})
    path = str(tmp_path / "bars")
    store.write_bars(spark.createDataFrame(rows), path)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    later = pd.date_range("2024-03-20", periods=40, freq="D")
    more = pd.concat([pd.DataFrame({"symbol": s, "ts": later, "close": 2.0}) for s in ("X", "NEW")])
    incoming = spark.createDataFrame(more)
    store.top_up_stored(spark, path, incoming, F.lit("2020-01-01").cast("timestamp"))
    out = store.scan_bars(spark, path, schema=incoming.schema).toPandas()
    x = out[out.symbol == "X"].set_index("ts").close
    last = days[-1] - pd.Timedelta(hours=72)
    assert len(x) == len(set(days) | set(later)) and all(v == (2.0 if t >= last else 1.0) for t, v in x.items())
    assert (out.symbol == "NEW").sum() == 40
    after = {str(f) for f in (tmp_path / "bars").rglob("*.parquet")}
    assert {f for f in before if "symbol=X/month=2024-01" in f or "symbol=X/month=2024-02" in f or "symbol=X/month=2024-03" in f} <= after
