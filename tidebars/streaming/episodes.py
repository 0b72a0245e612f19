"""Trade episodes of a live signal, kept as keyed state.

Bars arrive in any order. Each symbol has a clock, its newest bar less the allowed delay: bars behind the clock are final
and are folded in time order, the others wait in a map by time, where a bar that is sent again replaces the one before
if its sequence number is not smaller. A bar that arrives behind the folded ones cannot change them any more; it leaves
as a ``late`` row instead of being lost or folded in at the wrong place, so a caller can merge it into the stored bars
and restate the symbol. A row without close moves the clock only (a heartbeat of a feed that has gone quiet).

The clock is kept in state and not taken from the query's watermark, which would drop late rows before they are seen
and hold all symbols back to the slowest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars.operators.backtest import COMMISSION_BPS
from tidebars.session import shared_folder
from tidebars.streaming.bars import newest, run_to_end, rocksdb, versions

DELAY_HOURS = 72
FEED = "symbol string, ts timestamp, open double, close double, fill_spread_fraction double, ingest_seq long"
OUTPUT = (
    "kind string, symbol string, trade_group long, entry_timestamp timestamp, exit_timestamp timestamp, direction int, entry_price double, "
    "exit_price double, holding_hours double, gross_trade_return double, net_trade_return double, trade_cost double, closed boolean"
)
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
BAR = "open double, close double, spread double, seq long"
HOUR = 3_600_000_000


class Episodes(StatefulProcessor):
    """Fast against slow exponential mean; positions open at the next bar, costs as in the batch ledger."""

    def __init__(self, fast: int, slow: int, delay_hours: int = DELAY_HOURS, commission_bps: float = COMMISSION_BPS) -> None:
        self.spans, self.delay, self.commission = (fast, slow), delay_hours * HOUR, commission_bps / 1e4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "ts long", BAR)
        self.clock = handle.getValueState("clock", "newest long, folded long")
        # The last folded bar is not in any trade yet: its return needs the next bar's open.
        self.last = handle.getValueState("last", "n long, fast double, slow double, target int, executed int, prior int, ts long, open double, spread double")
        self.trade = handle.getValueState("trade", "number long, direction int, entry long, entry_price double, exit long, exit_price double, gross double, net double, cost double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new["t"] = new["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        newest_, folded = self.clock.get() if self.clock.exists() else (-(1 << 62), -(1 << 62))
        newest_ = max(newest_, int(new["t"].max()))
        bars = new[new["close"].notna()].sort_values("ingest_seq", kind="stable")
        behind = bars[bars["t"] <= folded]
        bars = bars[bars["t"] > folded].rename(columns={"fill_spread_fraction": "spread", "ingest_seq": "seq"})
        bars = bars[["t", "open", "close", "spread", "seq"]].drop_duplicates("t", keep="last")
        limit = newest_ - self.delay
        held = pd.DataFrame([(k[0], *v) for k, v in self.waiting.iterator()], columns=["t", "open", "close", "spread", "seq"])
        both = (pd.concat([held, bars], ignore_index=True) if len(held) else bars).sort_values("seq", kind="stable").drop_duplicates("t", keep="last")
        final = both[both["t"] <= limit].sort_values("t")
        for t in held["t"][held["t"] <= limit]:
            self.waiting.removeKey((int(t),))
        # Of what stays, only new rows that won over the held ones are written.
        stay = both[both["t"] > limit].merge(held[["t", "seq"]].rename(columns={"seq": "old"}), "left", "t") if len(held) else both[both["t"] > limit].assign(old=np.nan)
        replaced = set(bars["t"])
        for r in stay.itertuples(index=False):
            if r.t in replaced and not r.seq < (r.old if r.old == r.old else r.seq):
                self.waiting.updateValue((int(r.t),), (float(r.open), float(r.close), float(r.spread), int(r.seq)))
        if len(final):
            folded = int(final["t"].iloc[-1])
        self.clock.update((newest_, folded))
        out = self._fold(final) if len(final) else []
        out += [(t, None, None, t, None, o, c, None, None, None, None, None) for t, o, c in behind[["t", "open", "close"]].itertuples(index=False)]
        if out:
            yield self._frame(key[0], out, len(behind))

    def _fold(self, bars: pd.DataFrame) -> list[tuple]:
        """Carries signal and open trade over final bars; closed trades and the trade still open."""
        first = not self.last.exists()
        n, fast, slow, target, executed, prior, ts, open_, spread = (0, 0.0, 0.0, 0, 0, 0, 0, 0.0, 0.0) if first else self.last.get()
        close = bars["close"].to_numpy()
        means = []
        for last, span in zip((fast, slow), self.spans, strict=True):
            series = pd.Series(close if first else np.concatenate([[last], close]))
            means.append(series.ewm(span=span, adjust=False).mean().to_numpy()[-len(bars) :])
        seen = n + 1 + np.arange(len(bars))
        a, b = (np.where(seen >= span, m, np.nan) for m, span in zip(means, self.spans, strict=True))
        targets = np.where(a > b, 1, np.where(a < b, -1, 0))
        held = np.concatenate([[target], targets[:-1]])
        before = np.concatenate([[executed], held[:-1]])
        t, price, cost = bars["t"].to_numpy(), bars["open"].to_numpy(), bars["spread"].to_numpy()
        self.last.update((
            int(seen[-1]), float(means[0][-1]), float(means[1][-1]), int(targets[-1]), int(held[-1]), int(before[-1]), int(t[-1]), float(price[-1]), float(cost[-1]),
        ))
        if not first:
            held, before = np.concatenate([[executed], held]), np.concatenate([[prior], before])
            t, price, cost = np.concatenate([[ts], t]), np.concatenate([[open_], price]), np.concatenate([[spread], cost])
        return self._trades(t, price, cost, held, before)

    def _trades(self, t: np.ndarray, price: np.ndarray, spread: np.ndarray, held: np.ndarray, before: np.ndarray) -> list[tuple]:
        if len(t) < 2:
            return []
        bad = ~(spread[:-1] >= 0)
        if bad.any():
            raise ValueError("fill_spread_fraction is missing or negative")
        sides = np.abs(held - before)[:-1].astype(float)
        gross = held[:-1] * (price[1:] / price[:-1] - 1)
        cost = sides * (spread[:-1] / 2 + self.commission)
        now = self.trade.get() if self.trade.exists() else None
        starts = np.flatnonzero((held[:-1] != before[:-1]) | (np.arange(len(t) - 1) == 0) & (now is None))
        cuts = [0, *starts[starts > 0].tolist(), len(t) - 1]
        fresh = set(starts.tolist())
        out = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x in fresh:
                if now is not None and now[1]:
                    out.append((*now, True))
                now = ((now[0] if now else 0) + 1, int(held[x]), int(t[x]), float(price[x]), 0, 0.0, 1.0, 1.0, 0.0)
            number, direction, entry, entry_price, _, _, g, net, paid = now
            now = (
                number, direction, entry, entry_price, int(t[y - 1]), float(price[y]), g * float(np.prod(1 + gross[x:y])),
                net * float(np.prod(1 + gross[x:y] - cost[x:y])), paid + float(cost[x:y].sum()),
            )
        self.trade.update(now)
        if now[1]:
            out.append((*now, False))
        return [(e, g, d, x, None, p, q, (x - e) / HOUR + 1.0, gg - 1, nn - 1, c, done) for g, d, e, p, x, q, gg, nn, c, done in out]

    def _frame(self, symbol: str, rows: list[tuple], late: int) -> pd.DataFrame:
        entry, number, direction, leave, _, p, q, hours, gross, net, cost, closed = zip(*rows, strict=True)
        moment = lambda x: np.array(x, "int64").astype("datetime64[us]")
        kind = ["trade"] * (len(rows) - late) + ["late"] * late
        columns = (kind, symbol, pd.array(number, "Int64"), moment(entry), moment(leave), pd.array(direction, "Int32"), p, q, hours, gross, net, cost, pd.array(closed, "boolean"))
        return pd.DataFrame(dict(zip(NAMES, columns, strict=True)))

    def close(self) -> None:
        pass


def episodes(feed: DataFrame, fast: int = 12, slow: int = 72, delay_hours: int = DELAY_HOURS) -> DataFrame:
    """``feed`` (columns ``FEED``) to trades, each batch with the newest figures of an open one, and late bars."""
    return feed.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Episodes(fast, slow, delay_hours), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def run_episodes(spark: SparkSession, feed_path: str, out_path: str, fast: int = 12, slow: int = 72, delay_hours: int = DELAY_HOURS) -> str:
    """All that has arrived in ``feed_path`` since the last run; resumes from ``out_path``'s checkpoint."""
    with rocksdb(spark):
        feed = spark.readStream.schema(FEED).parquet(feed_path)
        return run_to_end(episodes(feed, fast, slow, delay_hours), "append", "episodes", out_path)


def trades_of(spark: SparkSession, data: str) -> DataFrame:
    """The newest state of every trade."""
    rows = newest(spark, data, T._parse_datatype_string(OUTPUT), ("kind", "symbol", "trade_group"))
    return rows.where("kind = 'trade'").drop("kind")


def late_bars(spark: SparkSession, data: str) -> DataFrame:
    """``symbol``, ``ts``, ``open`` and ``close`` of bars that came behind the clock."""
    rows = versions(spark, data, T._parse_datatype_string(OUTPUT)).where("kind = 'late'")
    return rows.select("symbol", F.col("entry_timestamp").alias("ts"), F.col("entry_price").alias("open"), F.col("exit_price").alias("close"))


def replay(spark: SparkSession, bars: DataFrame, parts: int = 6, fast: int = 12, slow: int = 72) -> DataFrame:
    """Stored bars sent again in ``parts`` runs, each resuming from the one before: some late, some twice.

    Of the last 48 hours of a part every third bar comes with the next part, and every fifth bar is sent twice, first
    with a wrong price. Trades must equal those of the batch computation.
    """
    feed_path, out_path = shared_folder(spark, "feed"), shared_folder(spark, "episodes")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = bars.agg(F.min(micros).alias("a"), F.max(micros).alias("b"))
    width = F.floor((F.col("b") - F.col("a")) / parts) + 1
    draw = F.pmod(F.xxhash64("symbol", "ts"), F.lit(15))
    part = F.floor((micros - F.col("a")) / width)
    left = width - F.pmod(micros - F.col("a"), width)
    dealt = bars.crossJoin(F.broadcast(span)).select(
        "symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "close", "fill_spread_fraction", F.lit(2).cast("long").alias("ingest_seq"),
        (part + (F.pmod(draw, F.lit(3)).eqNullSafe(F.lit(0)) & (left < 48 * HOUR)).cast("int")).alias("part"), F.pmod(draw, F.lit(5)).alias("again"),
    )
    wrong = dealt.where("again = 0").withColumns({"close": F.col("close") * 1.5, "open": F.col("open") * 0.5, "ingest_seq": F.lit(1).cast("long")})
    sent = dealt.unionByName(wrong)
    names = [c.split()[0] for c in FEED.split(", ")]
    ends = bars.groupBy("symbol").agg((F.max("ts").cast("timestamp") + F.expr(f"interval {DELAY_HOURS + 1} hours")).alias("ts"))
    beats = ends.select("symbol", "ts", *[F.lit(None).cast("double").alias(c) for c in ("open", "close", "fill_spread_fraction")], F.lit(0).cast("long").alias("ingest_seq"))
    for k in range(parts + 1):
        rows = sent.where(F.col("part") == k).select(*names)
        (rows.unionByName(beats) if k == parts else rows).write.mode("append").parquet(feed_path)
        done = run_episodes(spark, feed_path, out_path, fast, slow)
    return trades_of(spark, done)
