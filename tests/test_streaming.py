"""Streams against batch results: late, repeated and corrected rows, restarts and replayed batches."""

import datetime as dt

import numpy as np
import pytest

from tidebars.session import shared_folder
from tidebars.streaming import corrections as co
from tidebars.streaming import episodes as ep

START = dt.datetime(2024, 1, 1)


def direct_trades(opens, closes, spreads, fast, slow):
    """(entry, exit, direction, gross, net, cost, number) per trade, bar by bar."""
    means, target = [None, None], [0, 0]
    for i, c in enumerate(closes):
        for k, span in enumerate((fast, slow)):
            a = 2 / (span + 1)
            means[k] = c if means[k] is None else a * c + (1 - a) * means[k]
        target.append(int(np.sign(means[0] - means[1])) if i + 1 >= slow else 0)
    held, before = target[1:-1], target[:-2]
    out, number = [], 0
    for i in range(len(opens) - 1):
        if i == 0 or held[i] != before[i]:
            number += 1
            out.append([i, i, held[i], 1.0, 1.0, 0.0, number])
        gross = held[i] * (opens[i + 1] / opens[i] - 1)
        cost = abs(held[i] - before[i]) * (spreads[i] / 2 + 0.5e-4)
        row = out[-1]
        row[1:2], row[3:6] = [i], [row[3] * (1 + gross), row[4] * (1 + gross - cost), row[5] + cost]
    return [r for r in out if r[2]]


def test_episodes_over_batches(spark):
    """Seven restarts; late, repeated and far too late bars: trades of the bars in time order."""
    rng = np.random.default_rng(5)
    n = 400
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    opens, spreads = closes * np.exp(rng.normal(0, 0.002, n)), np.abs(rng.normal(1e-4, 2e-5, n))
    ts = [START + dt.timedelta(hours=i) for i in range(n)]
    feed, out = shared_folder(spark, "feed"), shared_folder(spark, "episodes")
    order = np.argsort(np.arange(n) + rng.integers(0, 30, n), kind="stable")
    schema = ep.FEED
    for k, piece in enumerate(np.array_split(order, 7)):
        rows = [("A", ts[i], float(opens[i]), float(closes[i]), float(spreads[i]), 5) for i in piece]
        # An older version of a bar that is already there, or comes with it, changes nothing.
        rows += [("A", ts[i], 1.0, 1.0, 0.0, 1) for i in piece[-5:]]
        if k == 5:
            rows.append(("A", ts[3], 7.0, 8.0, 0.0, 9))
        if k == 6:
            rows.append(("A", ts[-1] + dt.timedelta(hours=41), None, None, None, 0))
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        done = ep.run_episodes(spark, feed, out, 5, 12, 40)
    got = ep.trades_of(spark, done).orderBy("trade_group").collect()
    want = direct_trades(opens, closes, spreads, 5, 12)
    assert len(want) > 10 and [r.closed for r in got] == [True] * (len(want) - 1) + [False]
    for r, w in zip(got, want, strict=True):
        assert (r.entry_timestamp, r.exit_timestamp, r.direction, r.trade_group) == (ts[w[0]], ts[w[1]], w[2], w[6])
        assert np.allclose([r.gross_trade_return, r.net_trade_return, r.trade_cost], [w[3] - 1, w[4] - 1, w[5]], atol=1e-12)
        assert (r.entry_price, r.exit_price, r.holding_hours) == (opens[w[0]], opens[w[1] + 1], w[1] - w[0] + 1)
    late = ep.late_bars(spark, done).collect()
    assert [(r.ts, r.open, r.close) for r in late] == [(ts[3], 7.0, 8.0)]
    # A further run without new files changes nothing.
    ep.run_episodes(spark, feed, out, 5, 12, 40)
    assert ep.trades_of(spark, done).count() == len(want)


def test_bad_spread_stops_the_stream(spark):
    feed = shared_folder(spark, "feed")
    rows = [("A", START + dt.timedelta(hours=i), 100.0 + i, 100.0 + i, -1.0, 1) for i in range(50)]
    spark.createDataFrame(rows, ep.FEED).write.parquet(feed)
    with pytest.raises(Exception, match="fill_spread_fraction"):
        ep.run_episodes(spark, feed, shared_folder(spark, "episodes"), 2, 3, 1)


def test_batches_merge_once(spark):
    """A batch that dies between data and commit leaves the old snapshot; replayed it applies; replayed again it does nothing."""
    schema = "symbol string, ts timestamp, close double, ingest_seq long"
    path = shared_folder(spark, "corrected")

    def bars(*rows):
        return spark.createDataFrame([(s, START + dt.timedelta(days=d), c, q) for s, d, c, q in rows], schema)

    def now(upto=None):
        return {(r.symbol, (r.ts - START).days): r.close for r in co.read(spark, path, first.schema, upto=upto).collect()}

    first = bars(("A", 0, 1.0, 1), ("A", 40, 2.0, 1), ("B", 0, 3.0, 1), ("B", 0, 3.5, 2))
    co.create(spark, path, first.schema)
    assert now() == {}
    assert co.merge_batch(first, 0, path)
    before = {("A", 0): 1.0, ("A", 40): 2.0, ("B", 0): 3.5}
    assert now() == before
    # Corrects A 0 (a tie goes to the incoming bar), keeps B 0 (older), adds A 1 and C 0; A's second month stays as it is.
    second = bars(("A", 0, 1.5, 1), ("B", 0, 9.0, 1), ("A", 1, 4.0, 1), ("C", 0, 5.0, 1))
    # Half a version without a commit is not seen.
    half = second.withColumn("symbol", co.F.lit("A")).withColumn("month", co.F.lit("2024-01"))
    half.write.partitionBy("symbol", "month").parquet(f"{path}/data/version=1")
    assert now() == before
    after = {("A", 0): 1.5, ("A", 1): 4.0, ("A", 40): 2.0, ("B", 0): 3.5, ("C", 0): 5.0}
    assert co.merge_batch(second, 1, path) and now() == after
    assert not co.merge_batch(second, 1, path) and now() == after
    assert now(upto=0) == before
