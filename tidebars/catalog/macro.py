"""As-of enrichment and pair construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog import signals  # noqa: F401  (shared tables)
from tidebars.catalog.base import dbl, query
from tidebars.operators import asof, pairs
from tidebars.session import materialize
from tidebars.sources import ticks


def _bars(spark, d):
    return materialize(ticks.daily_bars(spark, d), "bars")


def _differential(name: str, column: str) -> None:
    @query(name, f"SELECT symbol, ts, {dbl(column)} FROM daily_macro")
    def run(spark, d):
        facts = asof.differentials(ticks.macro(spark, d)).select("symbol", "date", column)
        return asof.asof_join(ticks.daily_bars(spark, d), facts, (column,)).select("symbol", "ts", column)


_differential("asof_rate_diff", "interest_rate_differential")
_differential("asof_real_rate", "real_rate_differential")
_differential("asof_term_slope", "term_slope_differential")


@query("asof_global_series", f"SELECT symbol, ts, {dbl('vix_level')} FROM daily_macro")
def asof_global_series(spark, d):
    return asof.with_gauge(_bars(spark, d), ticks.macro(spark, d)).select("symbol", "ts", "vix_level")


@query(
    "series_routing",
    f"""SELECT series_id, CASE WHEN series_id = 'GAUGE' THEN 'gauge' ELSE split_part(series_id, '_', 1) END AS kind,
  CASE WHEN series_id <> 'GAUGE' THEN split_part(series_id, '_', 2) END AS currency, date, {dbl('value')} FROM macro""",
)
def series_routing(spark, d):
    return asof.series_routing(ticks.macro(spark, d))


PAIR = ("spread", "hedge_ratio")


@query("pair_spread", f"SELECT symbol, ts, {dbl(*PAIR)} FROM pair_resid")
def pair_spread(spark, d):
    return pairs.pair_spread(pairs.aligned_pairs(_bars(spark, d))).select("symbol", "ts", *PAIR)


PBAR = ("open", "high", "low", "close", "fill_spread_fraction", "leg_a_close", "leg_b_close")


@query("pair_bars", f"SELECT symbol, ts, {dbl(*PBAR)} FROM bars_p")
def pair_bars(spark, d):
    return pairs.pair_bars(_bars(spark, d))


@query(
    "cointegration_screen",
    """SELECT symbol, CAST(n AS BIGINT) AS n, round(rho + 3.7e-8, 6) + 0.0 AS rho,
  round(rho / sqrt((dd - rho * du) / (n - 1) / uu) + 3.7e-8, 6) + 0.0 AS statistic FROM (
SELECT symbol, count(*) AS n, sum(dx * u) / sum(u * u) AS rho, sum(dx * u) AS du, sum(u * u) AS uu, sum(dx * dx) AS dd FROM (
  SELECT symbol, spread - lag(spread) OVER w AS dx, lag(spread) OVER w AS u FROM pair_resid WINDOW w AS (PARTITION BY symbol ORDER BY ts))
WHERE u IS NOT NULL GROUP BY symbol) WHERE n >= 99""",
)
def cointegration_screen(spark, d):
    return pairs.fixed_lag_statistic(_bars(spark, d))


@query("cointegration_pvalue")
def cointegration_pvalue(spark, d):
    return pairs.screen(_bars(spark, d))
