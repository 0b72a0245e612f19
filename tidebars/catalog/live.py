"""Streaming bars and live signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import cte, dbl, query
from tidebars.catalog.signals import ema_sql, number_sql, signal_ctes, stored_daily
from tidebars.operators.positions import named, positions
from tidebars.plans import live
from tidebars.plans.families import REGISTRY
from tidebars.session import materialize
from tidebars.sources import ticks
from tidebars.streaming import bars as sb
from tidebars.streaming import corrections as sc
from tidebars.streaming import episodes as se
from tidebars.streaming import signals as ss

OHLCV = ("open", "high", "low", "close", "volume")
AS_OF = "2024-01-31 01:30:00"

cte("hourly_no", number_sql("bars_h"))


@query("latest_bars", f"SELECT symbol, ts, {dbl('open', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars_h) WHERE r <= 500")
def latest_bars(spark, d):
    return live.latest_bars(ticks.hourly_bars(spark, d)).select("symbol", "ts", "open", "close")


@query("staleness", f"SELECT symbol, last_ts, round((epoch(TIMESTAMP '{AS_OF}') - epoch(last_ts)) / 3600 + 3.7e-8, 6) + 0.0 AS age_hours, (epoch(TIMESTAMP '{AS_OF}') - epoch(last_ts)) / 3600 > 3 AS stale FROM (SELECT symbol, max(ts) AS last_ts FROM bars_h GROUP BY 1)")
def staleness(spark, d):
    return live.staleness(ticks.hourly_bars(spark, d), F.lit(AS_OF).cast("timestamp"))


@query("latest_signal", "SELECT family, symbol, params_key, max(ts) AS ts, arg_max(target, ts) AS target FROM sig_mr_zscore_t GROUP BY 1, 2, 3", signal_ctes("mean_reversion"))
def latest_signal(spark, d):
    want = [("mean_reversion", p) for p in REGISTRY["mean_reversion"].combinations()]
    return named(live.latest_signal(positions(stored_daily(spark, d), want)), want)


@query("stream_bars", f"SELECT symbol, ts, trade_count, {dbl(*OHLCV)} FROM bars_h")
def stream_bars(spark, d):
    return sb.stream_bars(spark, d)


@query(
    "stream_sliding",
    f"""SELECT symbol, ts, count(*) AS trade_count, round(arg_min(p, (t, event_id)) + 3.7e-8, 6) AS open, round(max(p) + 3.7e-8, 6) AS high, round(min(p) + 3.7e-8, 6) AS low,
  round(arg_max(p, (t, event_id)) + 3.7e-8, 6) AS close, round(sum(value) + 3.7e-8, 6) AS volume FROM (
SELECT event_type AS symbol, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS ts, ts AS t, event_id, 100 + value / 10 AS p, value FROM events, range(0, 24) r(k)) GROUP BY 1, 2""",
)
def stream_sliding(spark, d):
    return sb.stream_bars(spark, d, "24 hours", "1 hour")


@query("stream_dedup", f"SELECT event_id, event_type, ts, {dbl('value')} FROM events")
def stream_dedup(spark, d):
    return sb.stream_dedup(spark, d)


@query(
    "stream_session",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 90 MINUTE AS session_end, count(*) AS ticks, round(sum(value) + 3.7e-8, 6) + 0.0 AS volume FROM (
SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, g""",
)
def stream_session(spark, d):
    return sb.stream_sessions(spark, d)


@query(
    "stream_signal",
    f"SELECT symbol, ts, {dbl('fast', 'slow')}, target, CAST(coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY ts), 0) AS INTEGER) AS executed FROM "
    f"(SELECT h.symbol, h.ts, fast, slow, CASE WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 ELSE 0 END AS target FROM hourly_no h JOIN {ema_sql('hourly_no', 'close', {'fast': 12, 'slow': 72})} e USING (symbol, bar_no))",
)
def stream_signal(spark, d):
    return ss.stream_cross(spark, materialize(ticks.hourly_bars(spark, d), "bars"))


EPISODES = {
    "ep_signal": "SELECT h.symbol, h.ts, h.open, h.fill_spread_fraction AS s, lead(h.open) OVER (PARTITION BY h.symbol ORDER BY h.ts) AS nx, "
    f"CASE WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 ELSE 0 END AS target FROM hourly_no h JOIN {ema_sql('hourly_no', 'close', {'fast': 12, 'slow': 72})} e USING (symbol, bar_no)",
    "ep_held": "SELECT *, coalesce(lag(target) OVER w, 0) AS x, coalesce(lag(target, 2) OVER w, 0) AS b, row_number() OVER w AS r FROM ep_signal WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    "ep_book": "SELECT *, x * (nx / open - 1) AS g, abs(x - b) * (s / 2 + 0.5 / 1e4) AS c, sum(CASE WHEN r = 1 OR x <> b THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS trade_group "
    "FROM ep_held WHERE nx IS NOT NULL",
    "ep_trades": "SELECT symbol, CAST(trade_group AS BIGINT) AS trade_group, min(ts) AS entry_timestamp, max(ts) AS exit_timestamp, CAST(max(x) AS INTEGER) AS direction, arg_min(open, ts) AS entry_price, "
    "arg_max(nx, ts) AS exit_price, (epoch(max(ts)) - epoch(min(ts))) / 3600 + 1 AS holding_hours, product(1 + g) - 1 AS gross_trade_return, product(1 + g - c) - 1 AS net_trade_return, "
    "sum(c) AS trade_cost FROM ep_book WHERE x <> 0 GROUP BY symbol, trade_group",
}
EPISODE_D = ("entry_price", "exit_price", "holding_hours", "gross_trade_return", "net_trade_return", "trade_cost")


@query("stream_trades", f"SELECT symbol, trade_group, entry_timestamp, exit_timestamp, direction, {dbl(*EPISODE_D)} FROM ep_trades", EPISODES)
def stream_trades(spark, d):
    return se.replay(spark, materialize(ticks.hourly_bars(spark, d), "bars")).drop("closed")


@query("stream_corrections", f"SELECT symbol, ts, {dbl('open', 'close')} FROM (SELECT symbol, ts, open, CASE WHEN CAST(epoch(ts) / 3600 AS BIGINT) % 60 % 4 = 0 THEN close * 2 ELSE close END AS close FROM bars_h)")
def stream_corrections(spark, d):
    return sc.replay(spark, ticks.hourly_bars(spark, d)).select("symbol", "ts", "open", "close")
