"""Indicators and the 36 rule families, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import ORACLES, QUERIES, cte, dbl, query, runner, with_ctes
from tidebars.functions import indicators as ind
from tidebars.functions.indicators import num
from tidebars.operators import asof, pairs
from tidebars.operators.panel import make_panel, number_bars
from tidebars.operators.positions import named, positions
from tidebars.operators.sar import sar_codes
from tidebars.plans.families import REGISTRY
from tidebars.session import materialize
from tidebars.sources import ticks


def numbered_daily(spark, d):
    return number_bars(ticks.daily_bars(spark, d))


def stored_daily(spark, d, macro: bool = False):
    """Daily bars written once, then numbered: research reads a stored bar table (and stored series, which several joins use)."""
    bars = materialize(ticks.daily_bars(spark, d), "bars")
    if macro:
        bars = materialize(asof.enrich(bars, materialize(ticks.macro(spark, d), "macro")), "bars")
    return number_bars(bars)


def stored_pairs(spark, d, bars=None):
    """Pair bars written once, then numbered; ``bars`` are stored daily bars, if there are any."""
    bars = materialize(ticks.daily_bars(spark, d), "bars") if bars is None else bars
    return number_bars(materialize(pairs.pair_bars(bars), "pairs"))


# --- SQL building blocks -------------------------------------------------------------
OVER = "OVER (PARTITION BY symbol ORDER BY bar_no)"


def number_sql(source: str) -> str:
    w = "OVER (PARTITION BY symbol ORDER BY ts)"
    return f"SELECT *, row_number() {w} - 1 AS bar_no, lag(ts) {w} AS prev_ts, lead(open) {w} AS next_open FROM {source}"


cte("daily_no", number_sql("bars_d"))
LEGS_SQL = ", ".join(f"('{s}', '{b}', '{q}')" for s, (b, q) in ticks.CURRENCY_LEGS.items())
cte("leg_map", f"SELECT * FROM (VALUES {LEGS_SQL}) t(symbol, base, quote)")
cte(
    "currency_wide",
    """SELECT split_part(series_id, '_', 2) AS currency, date,
  max(CASE WHEN series_id LIKE 'policy%' THEN value END) AS policy,
  max(CASE WHEN series_id LIKE 'inflation%' THEN value END) AS inflation,
  max(CASE WHEN series_id LIKE 'yield%' THEN value END) AS yld
FROM macro WHERE series_id <> 'GAUGE' GROUP BY 1, 2""",
)
cte(
    "diffs",
    """SELECT m.symbol, b.date, b.policy - q.policy AS rate,
  (b.policy - b.inflation) - (q.policy - q.inflation) AS real_rate,
  (b.yld - b.policy) - (q.yld - q.policy) AS slope
FROM leg_map m JOIN currency_wide b ON b.currency = m.base JOIN currency_wide q ON q.currency = m.quote AND q.date = b.date""",
)
for _n in ("rate", "real_rate", "slope"):
    cte(f"fact_{_n}", f"SELECT symbol, date, {_n} FROM diffs WHERE {_n} IS NOT NULL")
cte("fact_gauge", "SELECT date, value FROM macro WHERE series_id = 'GAUGE'")
cte(
    "daily_macro",
    """SELECT b.*, f1.rate AS interest_rate_differential, f2.real_rate AS real_rate_differential,
  f3.slope AS term_slope_differential, g.value AS vix_level
FROM daily_no b ASOF LEFT JOIN fact_rate f1 ON b.symbol = f1.symbol AND b.ts >= f1.date
ASOF LEFT JOIN fact_real_rate f2 ON b.symbol = f2.symbol AND b.ts >= f2.date
ASOF LEFT JOIN fact_slope f3 ON b.symbol = f3.symbol AND b.ts >= f3.date
ASOF LEFT JOIN fact_gauge g ON b.ts >= g.date""",
)
cte(
    "pair_rows",
    """SELECT a.symbol || '_' || b.symbol AS symbol, a.ts, a.close AS leg_a_close, b.close AS leg_b_close,
  a.fill_spread_fraction AS spread_a, b.fill_spread_fraction AS spread_b
FROM bars_d a JOIN bars_d b ON a.ts = b.ts AND a.symbol < b.symbol""",
)
cte("pair_fit", "SELECT symbol, regr_slope(leg_a_close, leg_b_close) AS hedge_ratio, regr_intercept(leg_a_close, leg_b_close) AS intercept FROM pair_rows GROUP BY 1")
cte("pair_resid", "SELECT r.*, hedge_ratio, intercept, leg_a_close - intercept - hedge_ratio * leg_b_close AS spread FROM pair_rows r JOIN pair_fit USING (symbol)")
cte("pair_shift", "SELECT symbol, min(spread) AS lowest, stddev_samp(spread) AS sd FROM pair_resid GROUP BY 1")
cte(
    "bars_p",
    """SELECT symbol, ts, spread - lowest + sd AS open, spread - lowest + sd AS high, spread - lowest + sd AS low,
  spread - lowest + sd AS close, spread_a + abs(hedge_ratio) * spread_b AS fill_spread_fraction, leg_a_close, leg_b_close
FROM pair_resid JOIN pair_shift USING (symbol)""",
)
cte("pairs_no", number_sql("bars_p"))


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(expr: str, n: int, seed: int = 0) -> str:
    return f"CASE WHEN bar_no >= {seed + n - 1} THEN {expr} {w(n)} END"


def roll_null(expr: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) {w(n)} = {n} THEN {expr} {w(n)} END"


def z_sql(col: str, n: int, seed: int | None = 0) -> str:
    r = (lambda e: roll(e, n, seed)) if seed is not None else (lambda e: roll_null(e, col, n))
    return f"({col} - {r(f'avg({col})')}) / (CASE WHEN {r(f'stddev_pop({col})')} > 0 THEN {r(f'stddev_pop({col})')} END)"


def lag_sql(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) {OVER}"


def layers(source: str, *steps: dict[str, str]) -> str:
    """Nested selects, each adding named expressions."""
    sql = source
    for step in steps:
        items = ", ".join(f"{e} AS {n}" for n, e in step.items())
        sql = f"(SELECT *, {items} FROM {sql})"
    return sql


def ema_sql(source: str, col: str, spans: dict[str, int], seed: int = 0) -> str:
    """Exponential means in closed form: every earlier value times its weight."""
    items = []
    for name, span in spans.items():
        a = 2 / (span + 1)
        weight = f"power({1 - a!r}, b.bar_no - p.bar_no) * CASE WHEN p.bar_no = {seed} THEN 1.0 ELSE {a!r} END"
        items.append(f"CASE WHEN b.bar_no >= {seed + span - 1} THEN sum(p.{col} * {weight}) END AS {name}")
    return (
        f"(SELECT b.symbol, b.bar_no, {', '.join(items)} FROM {source} b JOIN {source} p ON p.symbol = b.symbol "
        f"AND p.bar_no <= b.bar_no AND p.bar_no >= {seed} GROUP BY b.symbol, b.bar_no)"
    )


def with_ema(source: str, table: str, col: str, spans: dict[str, int], seed: int = 0) -> str:
    return f"(SELECT s.*, e.* EXCLUDE (symbol, bar_no) FROM {source} s LEFT JOIN {ema_sql(table, col, spans, seed)} e USING (symbol, bar_no))"


TR = f"greatest(high - low, abs(high - {lag_sql('close')}), abs(low - {lag_sql('close')}))"
RET1 = f"close / (CASE WHEN {lag_sql('close')} <> 0 THEN {lag_sql('close')} END) - 1"

# --- indicator queries ---------------------------------------------------------------


def indicator(name: str, build, columns: list[str], sql: str, ctes=None, pairs_data: bool = False, lookback: int = 128):
    cols = {c: c for c in columns}
    is_bool = [c for c in columns if c.startswith("flag_")]
    numeric = [c for c in columns if c not in is_bool]
    select = ", ".join(["symbol", "ts", *([dbl(*numeric)] if numeric else []), *is_bool])

    @query(name, f"SELECT {select} FROM {sql}", ctes)
    def run(spark, d):
        bars = stored_pairs(spark, d) if pairs_data else numbered_daily(spark, d)
        p = build(make_panel(bars, ("symbol",), lookback))
        return p.settle().select("symbol", "ts", *cols)

    return run


def _rename(p, **names):
    return p.add(**{new: F.col(old) for new, old in names.items()})


D = "daily_no"
indicator("ema", lambda p: ind.ema(ind.ema(p, "close", 12, "ema12"), "close", 48, "ema48"), ["ema12", "ema48"],
          with_ema(D, D, "close", {"ema12": 12, "ema48": 48}), lookback=ind.ema_halo(48))
indicator("true_range", ind.true_range, ["tr"], layers(D, {"tr": TR}))
indicator("atr", lambda p: ind.atr(p, 14), ["atr_14"], layers(D, {"tr": TR}, {"atr_14": roll("avg(tr)", 14)}))
indicator("bollinger", lambda p: ind.bollinger(p, 20).add(upper=F.col("sma_20") + 2 * F.col("sd_20"), lower=F.col("sma_20") - 2 * F.col("sd_20")),
          ["sma_20", "upper", "lower"],
          layers(D, {"sma_20": roll("avg(close)", 20), "sd_20": roll("stddev_pop(close)", 20)}, {"upper": "sma_20 + 2 * sd_20", "lower": "sma_20 - 2 * sd_20"}))
indicator("keltner", lambda p: ind.close_ema(ind.atr(p, 20), 20).add(upper=F.col("ema_20") + 1.5 * F.col("atr_20"), lower=F.col("ema_20") - 1.5 * F.col("atr_20")),
          ["ema_20", "upper", "lower"],
          layers(with_ema(layers(D, {"tr": TR}, {"atr_20": roll("avg(tr)", 20)}), D, "close", {"ema_20": 20}), {"upper": "ema_20 + 1.5 * atr_20", "lower": "ema_20 - 1.5 * atr_20"}),
          lookback=ind.ema_halo(20))
MACD_CTES = {"macd_base": f"SELECT * FROM {layers(with_ema(D, D, 'close', {'ema_12': 12, 'ema_26': 26}), {'line': 'ema_12 - ema_26'})}"}
indicator("macd", lambda p: _rename(ind.macd(p, 12, 26, 9), line="macd_12_26", signal="macdsig_12_26_9").add(histogram=F.col("line") - F.col("signal")),
          ["line", "signal", "histogram"],
          layers(with_ema("macd_base", "macd_base", "line", {"signal": 9}, seed=25), {"histogram": "line - signal"}), MACD_CTES, lookback=ind.ema_halo(26) + ind.ema_halo(9))
TPV = "(high + low + close) / 3 * volume"
VOLSUM = roll("sum(volume)", 24)
indicator("vwap", lambda p: ind.vwap(p, 24), ["vwap_24"],
          layers(D, {"tpv": TPV}, {"vwap_24": f"({roll('sum(tpv)', 24)}) / (CASE WHEN {VOLSUM} > 0 THEN {VOLSUM} END)"}))


def adx_layers(source: str, windows: list[int]) -> str:
    up, down = f"high - {lag_sql('high')}", f"{lag_sql('low')} - low"
    a = {"tr": TR, "up": up, "down": down}
    b = {"pdm": "CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END", "mdm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END"}
    s3, s4, s5, s6 = {}, {}, {}, {}
    for n in windows:
        s3 |= {f"atr_{n}": roll("avg(tr)", n), f"sp_{n}": roll("avg(pdm)", n), f"sm_{n}": roll("avg(mdm)", n)}
        s4 |= {f"pdi_{n}": f"100 * sp_{n} / (CASE WHEN atr_{n} > 0 THEN atr_{n} END)", f"mdi_{n}": f"100 * sm_{n} / (CASE WHEN atr_{n} > 0 THEN atr_{n} END)"}
        s5 |= {f"dx_{n}": f"100 * abs(pdi_{n} - mdi_{n}) / (CASE WHEN pdi_{n} + mdi_{n} > 0 THEN pdi_{n} + mdi_{n} END)"}
        s6 |= {f"adx_{n}": roll_null(f"avg(dx_{n})", f"dx_{n}", n)}
    return layers(source, a, b, s3, s4, s5, s6)


indicator("adx", lambda p: ind.adx(p, 14), ["pdi_14", "mdi_14", "adx_14"], adx_layers(D, [14]))


def rsi_layers(source: str, windows: list[int]) -> str:
    s3, s4 = {}, {}
    for n in windows:
        s3 |= {f"g_{n}": roll("avg(gain)", n, 1), f"l_{n}": roll("avg(loss)", n, 1)}
        s4 |= {f"rsi_{n}": f"100 - 100 / (1 + g_{n} / (CASE WHEN l_{n} > 0 THEN l_{n} END))"}
    return layers(source, {"diff1": f"close - {lag_sql('close')}"},
                  {"gain": "CASE WHEN diff1 IS NOT NULL THEN greatest(diff1, 0.0) END", "loss": "CASE WHEN diff1 IS NOT NULL THEN greatest(-diff1, 0.0) END"}, s3, s4)


indicator("rsi", lambda p: ind.rsi(p, 14), ["rsi_14"], rsi_layers(D, [14]))
indicator("zscore_level", lambda p: ind.zscore(p, "close", 24, "z"), ["z"], layers(D, {"z": z_sql("close", 24)}))
indicator("zscore_return", lambda p: ind.zscore(ind.returns(p), "ret1", 24, "z", seed=1), ["z"], layers(D, {"ret1": RET1}, {"z": z_sql("ret1", 24, 1)}))
indicator("zscore_diff", lambda p: ind.zscore(ind.change(p, "close", 1, "diff1"), "diff1", 24, "z", seed=1), ["z"],
          layers("pairs_no", {"diff1": f"close - {lag_sql('close')}"}, {"z": z_sql("diff1", 24, 1)}), pairs_data=True)


def mid_sql(n: int) -> str:
    return f"({roll('max(high)', n)} + {roll('min(low)', n)}) / 2"


def mom_sql(k: int, col: str = "close") -> str:
    return f"{col} / (CASE WHEN {lag_sql(col, k)} <> 0 THEN {lag_sql(col, k)} END) - 1"


indicator("donchian", lambda p: ind.donchian(p, 120), ["mid_120"], layers(D, {"mid_120": mid_sql(120)}))
indicator("momentum_k", lambda p: ind.momentum(p, 24), ["mom_24"], layers(D, {"mom_24": mom_sql(24)}))
indicator("acceleration", lambda p: ind.acceleration(p, 24), ["acc_24"], layers(D, {"mom_24": mom_sql(24)}, {"acc_24": f"mom_24 - {lag_sql('mom_24', 24)}"}))
indicator("realized_vol", lambda p: ind.realized_vol(p, 24), ["annvol_24"],
          layers(D, {"ret1": RET1}, {"annvol_24": f"({roll('stddev_pop(ret1)', 24, 1)}) * sqrt(6048) * 100"}))
indicator("vol_zscore", lambda p: ind.vol_zscore(p, 12), ["volz_12"],
          layers(D, {"ret1": RET1}, {"rvol": roll("stddev_pop(ret1)", 12, 1)}, {"volz_12": z_sql("rvol", 48, 12)}))


def corr_layers(source: str, windows: list[int]) -> str:
    s2, s3 = {}, {}
    for n in windows:
        s2 |= {f"corr_{n}": roll("corr(ra, rb)", n, 1)}
        s3 |= {f"corrz_{n}": z_sql(f"corr_{n}", 4 * n, None), f"sma_{n}": roll("avg(close)", n)}
    return layers(source, {"ra": mom_sql(1, "leg_a_close"), "rb": mom_sql(1, "leg_b_close")}, s2, s3)


indicator("rolling_corr", lambda p: ind.leg_correlation(p, 48), ["corr_48", "corrz_48"], corr_layers("pairs_no", [48]), pairs_data=True, lookback=256)


def prior_range_sql(n: int) -> str:
    return f"CASE WHEN bar_no >= {n} THEN avg(high - low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


indicator("range_expansion", lambda p: ind.range_expansion(p, 20), ["avgrange_20"], layers(D, {"avgrange_20": prior_range_sql(20)}))


def squeeze_layers(source: str, combos: list[tuple[int, float, float]]) -> str:
    spans = sorted({n for n, _, _ in combos})
    s2, s3, s4 = {}, {}, {}
    for n in spans:
        s2 |= {f"sma_{n}": roll("avg(close)", n), f"sd_{n}": roll("stddev_pop(close)", n), f"atr_{n}": roll("avg(tr)", n)}
    for n, k, m in combos:
        key = f"{n}_{num(k)}_{num(m)}"
        width = f"((sma_{n} + {k} * sd_{n}) - (sma_{n} - {k} * sd_{n})) < ((ema_{n} + {m} * atr_{n}) - (ema_{n} - {m} * atr_{n}))"
        s3[f"sqon_{key}"] = f"coalesce({width}, false)"
        s4[f"sqoff_{key}"] = f"coalesce({lag_sql(f'sqon_{key}')}, false) AND NOT sqon_{key}"
    base = with_ema(layers(source, {"tr": TR}), source, "close", {f"ema_{n}": n for n in spans})
    return layers(base, s2, s3, s4)


indicator("squeeze", lambda p: _rename(ind.squeeze(p, 20, 2.0, 1.5), flag_on="sqon_20_2_1p5", flag_release="sqoff_20_2_1p5"), ["flag_on", "flag_release"],
          f"(SELECT symbol, ts, sqon_20_2_1p5 AS flag_on, sqoff_20_2_1p5 AS flag_release FROM {squeeze_layers(D, [(20, 2.0, 1.5)])})", lookback=ind.ema_halo(20))


def pctb_layers(source: str, combos: list[tuple[int, float]]) -> str:
    s1, s2 = {}, {}
    for n, k in combos:
        s1 |= {f"sma_{n}": roll("avg(close)", n), f"sd_{n}": roll("stddev_pop(close)", n)}
        lo, hi = f"(sma_{n} - {k} * sd_{n})", f"(sma_{n} + {k} * sd_{n})"
        s2[f"pctb_{n}_{num(k)}"] = f"(close - {lo}) / (CASE WHEN {hi} - {lo} > 0 THEN {hi} - {lo} END) - 0.5"
    return layers(source, s1, s2)


indicator("pct_b", lambda p: ind.pct_b(p, 20, 2.0), ["pctb_20_2"], pctb_layers(D, [(20, 2.0)]))


def vwapz_layers(source: str, windows: list[int]) -> str:
    s2, s3, s4 = {}, {}, {}
    for n in windows:
        v = roll("sum(volume)", n)
        s2[f"vdev_{n}"] = f"close - ({roll('sum(tpv)', n)}) / (CASE WHEN {v} > 0 THEN {v} END)"
        sd = roll_null(f"stddev_pop(vdev_{n})", f"vdev_{n}", n)
        s3[f"vwapz_{n}"] = f"vdev_{n} / (CASE WHEN {sd} > 0 THEN {sd} END)"
    return layers(source, {"tpv": TPV}, s2, s3)


def hedge_layers(source: str, windows: list[int]) -> str:
    s1, s2, s3 = {}, {}, {}
    for n in windows:
        var = f"var_pop(leg_b_close) {w(n)}"
        s1[f"hedge_{n}"] = f"CASE WHEN bar_no >= {n - 1} THEN covar_samp(leg_a_close, leg_b_close) {w(n)} / (CASE WHEN {var} > 0 THEN {var} END) END"
        s2[f"rspread_{n}"] = f"CASE WHEN bar_no >= {n - 1} THEN leg_a_close - (avg(leg_a_close) {w(n)} - hedge_{n} * avg(leg_b_close) {w(n)}) - hedge_{n} * leg_b_close END"
        s3[f"rhz_{n}"] = z_sql(f"rspread_{n}", n, None)
    return layers(source, s1, s2, s3)


indicator("rolling_hedge", lambda p: ind.rolling_hedge(p, 48), ["hedge_48", "rspread_48"], hedge_layers("pairs_no", [48]), pairs_data=True)


# --- parabolic stop-and-reverse in SQL -----------------------------------------------
def sar_sql(params: list[dict]) -> dict[str, str]:
    grid = ", ".join(f"({i + 1}, {p['acceleration_step']}, {p['acceleration_max']})" for i, p in enumerate(params))
    two = f"lag(low, 2) {OVER}, lag(high, 2) {OVER}"
    return {
        "sar_bars": f"SELECT symbol, bar_no, high, low, close, lag(low) {OVER} AS l1, lag(high) {OVER} AS h1, "
        f"lag(low, 2) {OVER} AS l2, lag(high, 2) {OVER} AS h2, lag(close) {OVER} AS c1 FROM daily_no",
        "sar_grid": f"SELECT * FROM (VALUES {grid}) t(pid, step, cap)",
        "sar_rec": """SELECT symbol, bar_no, pid, step, cap, up, stop, extreme, accel /*recursive*/ FROM (
  SELECT symbol, bar_no, pid, CAST(step AS DOUBLE) AS step, CAST(cap AS DOUBLE) AS cap, close > c1 AS up,
    CASE WHEN close > c1 THEN l1 ELSE h1 END AS stop, CASE WHEN close > c1 THEN high ELSE low END AS extreme, CAST(step AS DOUBLE) AS accel
  FROM sar_bars, sar_grid WHERE bar_no = 1)
UNION ALL
SELECT symbol, bar_no, pid, step, cap, CASE WHEN flip THEN NOT up ELSE up END,
  CASE WHEN flip THEN extreme ELSE cand END,
  CASE WHEN flip AND up THEN low WHEN flip THEN high WHEN up AND high > extreme THEN high WHEN NOT up AND low < extreme THEN low ELSE extreme END,
  CASE WHEN flip THEN step WHEN (up AND high > extreme) OR (NOT up AND low < extreme) THEN least(accel + step, cap) ELSE accel END
FROM (SELECT *, CASE WHEN up THEN low < cand ELSE high > cand END AS flip FROM (
  SELECT b.symbol, b.bar_no, r.pid, r.step, r.cap, r.up, r.extreme, r.accel, b.high, b.low,
    CASE WHEN r.up THEN least(r.stop + r.accel * (r.extreme - r.stop), b.l1, b.l2)
         ELSE greatest(r.stop + r.accel * (r.extreme - r.stop), b.h1, b.h2) END AS cand
  FROM sar_rec r JOIN sar_bars b ON b.symbol = r.symbol AND b.bar_no = r.bar_no + 1))""",
    }


@query(
    "psar",
    "SELECT b.symbol, b.ts, CASE WHEN r.up IS NULL THEN 0 WHEN r.up THEN 1 ELSE -1 END AS direction "
    "FROM daily_no b LEFT JOIN sar_rec r ON r.symbol = b.symbol AND r.bar_no = b.bar_no",
    sar_sql([{"acceleration_step": 0.02, "acceleration_max": 0.2}]),
)
def psar(spark, d):
    bars = sar_codes(stored_daily(spark, d), ("symbol",), [{"acceleration_step": 0.02, "acceleration_max": 0.2}])
    return bars.select("symbol", "ts", (F.col("sar_codes").cast("int") - 1).alias("direction"))


# --- rule families in SQL ------------------------------------------------------------
# Each entry: query name, family, source rows, and the rule as SQL text of its columns.
def revert_sql(x: str, entry: float, leave: float = 0.0):
    return (f"{x} IS NOT NULL", f"{x} <= {-entry}", f"{x} >= {entry}", f"{x} >= {-leave}", f"{x} <= {leave}")


def beyond_sql(x: str, t: float):
    return (f"{x} > {t}", f"{x} < {-t}")


def cross_sql(a: str, b: str):
    return (f"{a} > {b}", f"{a} < {b}")


def values(family: str, name: str) -> list:
    return list(REGISTRY[family].grid[name])


def macd_ctes(prefix: str, source: str) -> tuple[str, dict[str, str]]:
    """Lines of all fast/slow combinations, then every signal of every line."""
    fast, slow, sig = values("trend_macd", "fast_span"), values("trend_macd", "slow_span"), values("trend_macd", "signal_span")
    lines = {f"l_{f}_{s}": f"ema_{f} - ema_{s}" for f in fast for s in slow}
    base = layers(with_ema(source, source, "close", {f"ema_{n}": n for n in [*fast, *slow]}), lines)
    ctes = {f"{prefix}_lines": f"SELECT * FROM {base}"}
    joined = f"{prefix}_lines"
    for f in fast:
        for s in slow:
            joined = with_ema(joined, f"{prefix}_lines", f"l_{f}_{s}", {f"s_{f}_{s}_{g}": g for g in sig}, seed=max(f, s) - 1)
    ctes[f"{prefix}_signals"] = f"SELECT * FROM {joined}"
    return f"{prefix}_signals", ctes


def rule_table():
    macd_d, macd_d_ctes = macd_ctes("md", D)
    macd_p, macd_p_ctes = macd_ctes("mp", "pairs_no")
    ema_set = {f"ema_{n}": n for n in (12, 24, 48, 72, 120, 240, 480)}
    hist = {}
    for f in (12, 24):
        for s in (26, 52, 104):
            for g in (9, 18):
                hist[f"h_{f}_{s}_{g}"] = f"(l_{f}_{s} - s_{f}_{s}_{g}) / (CASE WHEN close <> 0 THEN close END)"
    slope = {f"d{k}": f"{k} - {lag_sql(k)}" for k in hist}
    mm = "daily_macro"
    rate = "interest_rate_differential"
    z_steps = {f"z_{n}": z_sql("close", n) for n in (24, 48, 96, 168)}
    moms = lambda ks: {f"mom_{k}": mom_sql(k) for k in ks}
    bands = lambda ns: {**{f"sma_{n}": roll("avg(close)", n) for n in ns}, **{f"sd_{n}": roll("stddev_pop(close)", n) for n in ns}}
    rvols = lambda ns: {f"rvol_{n}": roll("stddev_pop(ret1)", n, 1) for n in ns}
    t = {}
    t["sig_trend"] = ("trend", with_ema(D, D, "close", ema_set), {}, lambda p: cross_sql(f"ema_{p['fast_window']}", f"ema_{p['slow_window']}"))
    t["sig_trend_sma"] = ("trend_sma", layers(D, {f"sma_{n}": roll("avg(close)", n) for n in (120, 240, 480)}), {}, lambda p: cross_sql("close", f"sma_{p['window']}"))
    t["sig_trend_donchian"] = ("trend_donchian", layers(D, {f"mid_{n}": mid_sql(n) for n in (120, 240, 480)}), {}, lambda p: cross_sql("close", f"mid_{p['window']}"))
    t["sig_trend_macd"] = ("trend_macd", macd_d, macd_d_ctes, lambda p: cross_sql(f"l_{p['fast_span']}_{p['slow_span']}", f"s_{p['fast_span']}_{p['slow_span']}_{p['signal_span']}"))
    t["sig_trend_adx"] = ("trend_adx", adx_layers(D, [14, 24, 48]), {}, lambda p: (
        f"adx_{p['window']} > {p['adx_threshold']} AND pdi_{p['window']} > mdi_{p['window']}", f"adx_{p['window']} > {p['adx_threshold']} AND mdi_{p['window']} > pdi_{p['window']}"))
    sar_params = REGISTRY["trend_psar"].combinations()
    sar_src = "(SELECT b.*, " + ", ".join(f"r{i + 1}.up AS up_{num(p['acceleration_step'])}_{num(p['acceleration_max'])}" for i, p in enumerate(sar_params)) + f" FROM {D} b " + " ".join(
        f"LEFT JOIN sar_rec r{i + 1} ON r{i + 1}.symbol = b.symbol AND r{i + 1}.bar_no = b.bar_no AND r{i + 1}.pid = {i + 1}" for i in range(len(sar_params))) + ")"
    t["sig_trend_psar"] = ("trend_psar", sar_src, sar_sql(sar_params), lambda p: (
        f"up_{num(p['acceleration_step'])}_{num(p['acceleration_max'])}", f"NOT up_{num(p['acceleration_step'])}_{num(p['acceleration_max'])}"))
    t["sig_mr_zscore"] = ("mean_reversion", layers(D, z_steps), {}, lambda p: revert_sql(f"z_{p['lookback']}", p["entry_z"], p["exit_z"]))
    t["sig_mr_rsi"] = ("mean_reversion_rsi", rsi_layers(D, [14, 24, 48]), {}, lambda p: revert_sql(f"(rsi_{p['window']} - 50)", p["entry_band"]))
    t["sig_mr_return_z"] = ("mean_reversion_return_zscore", layers(D, {"ret1": RET1}, {f"rz_{n}": z_sql("ret1", n, 1) for n in (12, 24, 48)}), {}, lambda p: revert_sql(f"rz_{p['lookback']}", p["entry_z"]))
    t["sig_mr_bollinger"] = ("mean_reversion_bollinger", pctb_layers(D, [(n, k) for n in (20, 40, 80) for k in (1.5, 2.0, 2.5)]), {}, lambda p: revert_sql(f"pctb_{p['window']}_{num(p['num_std'])}", p["entry_band"]))
    t["sig_mr_keltner"] = ("mean_reversion_keltner", layers(with_ema(layers(D, {"tr": TR}), D, "close", {f"ema_{n}": n for n in (20, 40, 80)}), {f"atr_{n}": roll("avg(tr)", n) for n in (20, 40, 80)}), {}, lambda p: (
        f"ema_{p['window']} IS NOT NULL", f"close < ema_{p['window']} - {p['atr_multiple']} * atr_{p['window']}", f"close > ema_{p['window']} + {p['atr_multiple']} * atr_{p['window']}",
        f"close >= ema_{p['window']} - {p['exit_atr_multiple']} * atr_{p['window']}", f"close <= ema_{p['window']} + {p['exit_atr_multiple']} * atr_{p['window']}"))
    t["sig_mr_vwap"] = ("mean_reversion_vwap", vwapz_layers(D, [24, 48, 96]), {}, lambda p: revert_sql(f"vwapz_{p['lookback']}", p["entry_z"]))
    t["sig_mom"] = ("momentum", layers(D, moms((24, 36, 48, 96, 168))), {}, lambda p: beyond_sql(f"mom_{p['lookback']}", p["threshold"]))
    t["sig_mom_ewma"] = ("momentum_ewma", with_ema("ret_d", "ret_d", "ret1", {f"rema_{n}": n for n in (24, 96, 240)}, seed=1), {"ret_d": f"SELECT * FROM {layers(D, {'ret1': RET1})}"}, lambda p: beyond_sql(f"rema_{p['span']}", p["threshold"]))
    t["sig_mom_risk_adj"] = ("momentum_risk_adjusted", layers(D, {"ret1": RET1}, {**rvols((24, 96, 240)), **{f"rmean_{n}": roll("avg(ret1)", n, 1) for n in (24, 96, 240)}},
                             {f"rar_{n}": f"rmean_{n} / (CASE WHEN rvol_{n} > 0 THEN rvol_{n} END)" for n in (24, 96, 240)}), {}, lambda p: beyond_sql(f"rar_{p['window']}", p["threshold"]))

    def hist_rule(p):
        k = f"h_{p['fast_span']}_{p['slow_span']}_{p['signal_span']}"
        return (f"{k} > 0 AND d{k} > {p['threshold']}", f"{k} < 0 AND d{k} < {-p['threshold']}")

    t["sig_mom_macd_hist"] = ("momentum_macd_histogram", layers(macd_d, hist, slope), macd_d_ctes, hist_rule)
    t["sig_mom_volume"] = ("momentum_volume_confirmed", layers(D, {**moms((24, 48, 96)), **{f"av_{n}": roll("avg(volume)", n) for n in (24, 48, 96)}}), {}, lambda p: tuple(
        f"volume > {p['volume_ratio']} * av_{p['lookback']} AND {x}" for x in beyond_sql(f"mom_{p['lookback']}", p["return_threshold"])))
    t["sig_mom_accel"] = ("momentum_acceleration", layers(D, moms((24, 48, 96)), {f"acc_{k}": f"mom_{k} - {lag_sql(f'mom_{k}', k)}" for k in (24, 48, 96)}), {}, lambda p: beyond_sql(f"acc_{p['lookback']}", p["threshold"]))
    t["sig_vol_breakout"] = ("volatility", layers(D, bands((20, 40, 80))), {}, lambda p: (
        f"sma_{p['window']} IS NOT NULL", f"close > sma_{p['window']} + {p['num_std']} * sd_{p['window']}", f"close < sma_{p['window']} - {p['num_std']} * sd_{p['window']}",
        f"close <= sma_{p['window']} + {p['exit_num_std']} * sd_{p['window']}", f"close >= sma_{p['window']} - {p['exit_num_std']} * sd_{p['window']}"))
    t["sig_vol_atr"] = ("volatility_atr", layers(D, {"tr": TR}, {**bands((20, 40)), **{f"atr_{n}": roll("avg(tr)", n) for n in (20, 40)}}), {}, lambda p: (
        f"sma_{p['window']} IS NOT NULL AND atr_{p['window']} IS NOT NULL", f"close > sma_{p['window']} + {p['num_atr']} * atr_{p['window']}",
        f"close < sma_{p['window']} - {p['num_atr']} * atr_{p['window']}", f"close <= sma_{p['window']}", f"close >= sma_{p['window']}"))
    t["sig_vol_range"] = ("volatility_range_expansion", layers(D, {f"ar_{n}": prior_range_sql(n) for n in (20, 40)}), {}, lambda p: tuple(
        f"(high - low) > {p['expansion_multiple']} * (CASE WHEN ar_{p['window']} > 0 THEN ar_{p['window']} END) AND close {s} open" for s in "><"))
    t["sig_vol_vix"] = ("volatility_vix_regime", layers(mm, {"ret1": RET1}, rvols((24, 48, 96)), {f"prem_{n}": f"vix_level - rvol_{n} * sqrt(6048) * 100" for n in (24, 48, 96)}), {}, lambda p: beyond_sql(f"prem_{p['realized_vol_window']}", p["threshold"])[::-1])
    t["sig_vol_mr"] = ("volatility_mean_reversion", layers(D, {"ret1": RET1}, rvols((12, 24, 48)), {**{f"vz_{n}": z_sql(f"rvol_{n}", 4 * n, n) for n in (12, 24, 48)}, **{f"dr_{n}": f"close - {lag_sql('close', n)}" for n in (12, 24, 48)}}), {}, lambda p: (
        f"vz_{p['short_window']} IS NOT NULL AND dr_{p['short_window']} IS NOT NULL", f"vz_{p['short_window']} >= {p['entry_z']} AND dr_{p['short_window']} < 0",
        f"vz_{p['short_window']} >= {p['entry_z']} AND dr_{p['short_window']} > 0", f"vz_{p['short_window']} <= {p['exit_z']}", f"vz_{p['short_window']} <= {p['exit_z']}"))
    t["sig_vol_squeeze"] = ("volatility_squeeze", squeeze_layers(D, [(n, k, m) for n in (20, 40) for k in (1.5, 2.0) for m in (1.5, 2.0)]), {}, lambda p: (
        f"sd_{p['window']} IS NOT NULL", *[f"sqoff_{p['window']}_{num(p['num_std'])}_{num(p['atr_multiple'])} AND close {s} open" for s in "><"],
        *[f"sqon_{p['window']}_{num(p['num_std'])}_{num(p['atr_multiple'])}"] * 2))
    P = "pairs_no"
    t["sig_sa_zscore"] = ("stat_arb", layers(P, z_steps), {}, lambda p: revert_sql(f"z_{p['lookback']}", p["entry_z"], p["exit_z"]))
    t["sig_sa_rsi"] = ("stat_arb_rsi", rsi_layers(P, [14, 24, 48]), {}, lambda p: revert_sql(f"(rsi_{p['window']} - 50)", p["entry_band"]))
    t["sig_sa_diff_z"] = ("stat_arb_return_zscore", layers(P, {"diff1": f"close - {lag_sql('close')}"}, {f"dz_{n}": z_sql("diff1", n, 1) for n in (12, 24, 48)}), {}, lambda p: revert_sql(f"dz_{p['lookback']}", p["entry_z"]))
    t["sig_sa_macd"] = ("stat_arb_macd", macd_p, macd_p_ctes, lambda p: cross_sql(f"l_{p['fast_span']}_{p['slow_span']}", f"s_{p['fast_span']}_{p['slow_span']}_{p['signal_span']}"))
    t["sig_sa_rolling_hedge"] = ("stat_arb_rolling_hedge", hedge_layers(P, [24, 48, 96, 168]), {}, lambda p: revert_sql(f"rhz_{p['lookback']}", p["entry_z"], p["exit_z"]))
    t["sig_sa_corr"] = ("stat_arb_correlation_breakdown", corr_layers(P, [48, 96, 168]), {}, lambda p: (
        f"corrz_{p['corr_window']} IS NOT NULL AND sma_{p['corr_window']} IS NOT NULL", f"corrz_{p['corr_window']} <= {-p['entry_z']} AND close < sma_{p['corr_window']}",
        f"corrz_{p['corr_window']} <= {-p['entry_z']} AND close > sma_{p['corr_window']}", *[f"corrz_{p['corr_window']} >= {-p['exit_z']}"] * 2))
    t["sig_carry"] = ("carry", mm, {}, lambda p: beyond_sql(rate, p["threshold"]))
    t["sig_carry_mom"] = ("carry_rate_momentum", layers(mm, {f"dm_{k}": f"{rate} - {lag_sql(rate, k)}" for k in (720, 1440, 2160)}), {}, lambda p: beyond_sql(f"dm_{p['lookback']}", p["threshold"]))
    t["sig_carry_z"] = ("carry_zscore", layers(mm, {f"cz_{n}": z_sql(rate, n, None) for n in (720, 1440, 2160)}), {}, lambda p: revert_sql(f"cz_{p['lookback']}", p["entry_z"]))
    t["sig_carry_real"] = ("carry_real_rate", mm, {}, lambda p: beyond_sql("real_rate_differential", p["threshold"]))
    t["sig_carry_slope"] = ("carry_term_slope", mm, {}, lambda p: beyond_sql("term_slope_differential", p["threshold"]))
    t["sig_carry_risk"] = ("carry_risk_adjusted", layers(mm, {"ret1": RET1}, rvols((24, 48, 96)), {f"rac_{n}": f"{rate} / (CASE WHEN rvol_{n} > 0 THEN rvol_{n} END)" for n in (24, 48, 96)}), {}, lambda p: beyond_sql(f"rac_{p['window']}", p["threshold"]))
    return t


RULES = rule_table()
FAMILY_QUERY = {family: name for name, (family, *_) in RULES.items()}


def signal_ctes(family: str, params: list[dict] | None = None, name: str | None = None, from_sql: str | None = None) -> dict[str, str]:
    """Tables ending in ``<query name>_t``: symbol, ts, bar_no, params_key, target."""
    key = name or FAMILY_QUERY[family]
    _, source, ctes, rule = RULES[FAMILY_QUERY[family]]
    source = from_sql or source
    spec = REGISTRY[family]
    params = params or spec.combinations()
    labels = [spec.candidate_key(p) for p in params]
    rules = [rule(p) for p in params]
    n = len(params)
    out = dict(ctes)
    keys = "[" + ", ".join(f"'{k}'" for k in labels) + "]"
    if len(rules[0]) == 2:
        digits = [f"CASE WHEN {a} THEN '2' WHEN {b} THEN '0' ELSE '1' END" for a, b in rules]
        out[f"{key}_s"] = f"SELECT symbol, bar_no, {' || '.join(digits)} AS s FROM {source}"
    else:
        enter = [f"CASE WHEN NOT coalesce({av}, false) THEN 'u' WHEN {el} THEN '2' WHEN {es} THEN '0' ELSE '1' END" for av, el, es, _, _ in rules]
        leave = [[f"CASE WHEN {r[i]} THEN '1' ELSE '0' END" for r in rules] for i in (3, 4)]
        out[f"{key}_in"] = (
            f"SELECT symbol, bar_no, {' || '.join(enter)} AS e, {' || '.join(leave[0])} AS xl, {' || '.join(leave[1])} AS xs FROM {source}"
        )
        step = lambda s: (
            f"array_to_string([CASE WHEN substr(h.e, i, 1) = 'u' THEN '1' WHEN substr({s}, i, 1) = '1' THEN substr(h.e, i, 1) "
            f"WHEN substr({s}, i, 1) = '2' THEN (CASE WHEN substr(h.xl, i, 1) = '1' THEN '1' ELSE '2' END) "
            f"ELSE (CASE WHEN substr(h.xs, i, 1) = '1' THEN '1' ELSE '0' END) END FOR i IN range(1, {n + 1})], '')"
        )
        flat = "'" + "1" * n + "'"
        out[f"{key}_s"] = (
            f"SELECT h.symbol, h.bar_no, {step(flat)} AS s /*recursive*/ FROM {key}_in h WHERE h.bar_no = 0 UNION ALL "
            f"SELECT h.symbol, h.bar_no, {step('r.s')} FROM {key}_s r JOIN {key}_in h ON h.symbol = r.symbol AND h.bar_no = r.bar_no + 1"
        )
    base = {"pairs": "pairs_no"}.get(spec.universe, D)
    out[f"{key}_t"] = (
        f"SELECT '{family}' AS family, b.symbol, b.ts, b.bar_no, {keys}[i] AS params_key, CAST(substr(s.s, CAST(i AS BIGINT), 1) AS INTEGER) - 1 AS target "
        f"FROM {base} b JOIN {key}_s s ON s.symbol = b.symbol AND s.bar_no = b.bar_no, range(1, {n + 1}) r(i)"
    )
    return out


def family_bars(spark, d, family: str):
    spec = REGISTRY[family]
    if spec.universe == "pairs":
        return stored_pairs(spark, d)
    return stored_daily(spark, d, macro=spec.universe == "cash" or "vix_level" in spec.needs)


def _register(name: str, family: str) -> None:
    def run(spark, d):
        want = [(family, p) for p in REGISTRY[family].combinations()]
        return named(positions(family_bars(spark, d, family), want), want).select("family", "symbol", "params_key", "ts", F.col("target").cast("int").alias("target"))

    QUERIES[name] = runner(run)
    ORACLES[name] = with_ctes(f"SELECT family, symbol, params_key, ts, target FROM {name}_t", signal_ctes(family))


for _name, (_fam, *_rest) in RULES.items():
    _register(_name, _fam)
