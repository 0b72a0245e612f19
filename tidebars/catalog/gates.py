"""The four gates, step by step and as verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.backtests import (
    CK, CKEY, chain, ledger_sql, metric_columns, metrics_sql, nav_sql, runs_sql, trades_sql,
)
from tidebars.catalog.bars import event_rows
from tidebars.catalog.base import cte, dbl, query
from tidebars.catalog.signals import layers, roll, signal_ctes, stored_daily, stored_pairs
from tidebars.catalog.population import universe
from tidebars.functions import normal
from tidebars.operators import backtest as bt
from tidebars.operators import candidates as cand
from tidebars.operators.candidates import variant_plan
from tidebars.operators.positions import named, positions
from tidebars.plans import report
from tidebars.plans.families import REGISTRY
from tidebars.plans.gates import oos, population, resample, stress, walkforward
from tidebars.session import materialize

SPLIT = oos.Split("1995-01-01 00:00:00", "1998-12-31 23:59:59", "1999-01-01 00:00:00")
FOLDS = walkforward.Plan()
STRESS = stress.Stress(fixed_start="1998-03-01 00:00:00", fixed_end="1998-03-31 23:59:59")
TRIALS = resample.Resampling()
FAMILY = "trend_sma"
PARENTS = REGISTRY[FAMILY].combinations()


def plan_tables(tag: str, family: str, include_self: bool) -> dict[str, str]:
    """Signals of parents and variants as ``<tag>_t`` and their links as ``<tag>_links``."""
    plan, links = variant_plan(family, REGISTRY[family].combinations(), include_self)
    key = REGISTRY[family].candidate_key
    rows = ", ".join(f"('{key(plan[a][1])}', '{key(plan[b][1])}', {o})" for a, b, o in links)
    params = [p for _, p in plan]
    source = layers("daily_no", {f"sma_{p['window']}": roll("avg(close)", int(p["window"])) for p in params}) if family == "trend_sma" else None
    return {
        **signal_ctes(family, params, tag, source),
        f"{tag}_links": f"SELECT * FROM (VALUES {rows}) t(parent_key, params_key, ord)",
        f"{tag}_parents": f"SELECT unnest([{', '.join(repr(key(p)) for p in REGISTRY[family].combinations())}]) AS params_key",
    }


def fails(**checks: str) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{n}' END" for n, ok in checks.items()) + ")"


# --- gate 1 --------------------------------------------------------------------------
WIN = f"{CKEY}, win"


def gate1_ctes(tag: str, family: str, s: oos.Split = SPLIT) -> dict[str, str]:
    c = oos.Criteria()
    out = plan_tables(tag, family, include_self=False)
    out[f"{tag}_bt"] = ledger_sql(f"{tag}_t", "daily_no")
    out[f"{tag}_split"] = f"""SELECT *, CASE WHEN win = 'is' THEN TIMESTAMP '{s.in_sample_start}' ELSE TIMESTAMP '{s.out_of_sample_start}' END AS win_start FROM (
SELECT *, CASE WHEN ts BETWEEN TIMESTAMP '{s.in_sample_start}' AND TIMESTAMP '{s.in_sample_end}' THEN 'is' WHEN ts >= TIMESTAMP '{s.out_of_sample_start}' THEN 'oos' END AS win FROM {tag}_bt)
WHERE win IS NOT NULL"""
    out[f"{tag}_runs"] = runs_sql(f"{tag}_split", WIN, "prev_ts IS NULL OR prev_ts < win_start")
    out[f"{tag}_trades"] = trades_sql(f"{tag}_runs", WIN)
    out[f"{tag}_nav"] = nav_sql(f"{tag}_split", WIN)
    out[f"{tag}_met"] = metrics_sql(f"{tag}_nav", f"{tag}_trades", WIN)
    out[f"{tag}_top"] = f"""SELECT {WIN}, coalesce(sum(CASE WHEN r <= 5 THEN p END) / sum(p), 1.0) AS top_5_trade_profit_share FROM (
SELECT *, row_number() OVER (PARTITION BY {WIN} ORDER BY p DESC NULLS LAST, trade_group) AS r FROM (
  SELECT *, CASE WHEN net_trade_return > 0 THEN net_trade_return END AS p FROM {tag}_trades)) GROUP BY {WIN}"""
    out[f"{tag}_win"] = f"SELECT m.*, top_5_trade_profit_share FROM {tag}_met m LEFT JOIN {tag}_top USING ({WIN})"
    perf = fails(
        oos_net_sharpe=f"net_sharpe >= {c.minimum_sharpe}", oos_net_return=f"net_total_return > {c.minimum_return}",
        oos_trade_count=f"trade_count >= {c.minimum_trades}", trade_profit_concentration=f"top_5_trade_profit_share <= {c.maximum_top_share}",
    )
    out[f"{tag}_perf"] = f"SELECT *, {perf} AS performance_failures FROM {tag}_win WHERE win = 'oos'"
    out[f"{tag}_near"] = f"""SELECT *, {fails(
        positive_neighbor_count=f"positive_neighbor_count >= {c.minimum_positive_neighbors}",
        median_neighbor_sharpe=f"median_neighbor_sharpe >= {c.minimum_median_neighbor_sharpe}",
        worst_neighbor_sharpe=f"worst_neighbor_sharpe >= {c.minimum_worst_neighbor_sharpe}")} AS sensitivity_failures FROM (
SELECT family, symbol, parent_key, count(*) AS neighbor_count, CAST(count_if(net_total_return > 0 AND net_sharpe IS NOT NULL) AS BIGINT) AS positive_neighbor_count,
  median(net_sharpe) AS median_neighbor_sharpe, min(net_sharpe) AS worst_neighbor_sharpe
FROM {tag}_perf JOIN {tag}_links USING (params_key) GROUP BY 1, 2, 3)"""
    reasons = "CASE WHEN performance_failures IS NULL THEN 'no_oos_observations' ELSE concat_ws(';', nullif(performance_failures, ''), nullif(coalesce(sensitivity_failures, 'no_valid_neighbors'), '')) END"
    out[f"{tag}_gate"] = f"""SELECT c.*, p.* EXCLUDE (family, symbol, params_key), n.* EXCLUDE (family, symbol, parent_key), {reasons} AS failure_reason, {reasons} = '' AS layer1_pass
FROM (SELECT '{family}' AS family, symbol, params_key FROM (SELECT DISTINCT symbol FROM daily_no), {tag}_parents) c LEFT JOIN {tag}_perf p ON p.symbol = c.symbol AND p.params_key = c.params_key
LEFT JOIN {tag}_near n ON n.symbol = c.symbol AND n.parent_key = c.params_key"""
    return out


G1 = gate1_ctes("g1", FAMILY)
G1_PLAN = variant_plan(FAMILY, PARENTS, include_self=False)[0]


def g1_book(spark, d):
    return bt.ledger(positions(stored_daily(spark, d), G1_PLAN))


@query("split_is_oos", f"SELECT {CKEY}, ts, win, {dbl('net_return')} FROM g1_split", G1)
def split_is_oos(spark, d):
    return named(oos.split_book(g1_book(spark, d), SPLIT), G1_PLAN).select(*CK, "ts", "win", "net_return")


MD, MI = metric_columns()
WIN_D = [*MD, "top_5_trade_profit_share"]


@query("window_metrics", f"SELECT {WIN}, first_observation, last_observation, {', '.join(MI)}, {dbl(*WIN_D)} FROM g1_win", G1)
def window_metrics(spark, d):
    return named(oos.window_metrics(oos.window_runs(g1_book(spark, d), SPLIT)), G1_PLAN).select(
        *CK, "win", "first_observation", "last_observation", *MI, *WIN_D
    )


@query("top5_profit_share", f"SELECT {WIN}, {dbl('top_5_trade_profit_share')} FROM g1_win", G1)
def top5_profit_share(spark, d):
    return named(oos.top_share(oos.window_runs(g1_book(spark, d), SPLIT)), G1_PLAN).select(*CK, "win", "top_5_trade_profit_share")


L1_D = ("net_sharpe", "net_total_return", "top_5_trade_profit_share")


@query("l1_performance", f"SELECT {CKEY}, trade_count, {dbl(*L1_D)}, performance_failures, performance_failures = '' AS performance_pass FROM g1_perf", G1)
def l1_performance(spark, d):
    runs = oos.window_runs(g1_book(spark, d), SPLIT).filter(F.col("win") == "oos")
    out = named(oos.performance(oos.window_metrics(runs)), G1_PLAN)
    return out.select(*CK, "trade_count", *L1_D, F.array_join("performance_failures", ";").alias("performance_failures"), (F.size("performance_failures") == 0).alias("performance_pass"))


NEAR = ("median_neighbor_sharpe", "worst_neighbor_sharpe")


@query("l1_neighbors", f"SELECT family, symbol, parent_key AS params_key, neighbor_count, positive_neighbor_count, {dbl(*NEAR)}, sensitivity_failures FROM g1_near", G1)
def l1_neighbors(spark, d):
    metrics, links, plan = oos.neighbor_metrics(stored_daily(spark, d), FAMILY, PARENTS, SPLIT)
    near = named(oos.sensitivity(metrics, links).withColumnRenamed("parent", "cand"), plan)
    return near.select(*CK, "neighbor_count", "positive_neighbor_count", *NEAR, F.array_join("sensitivity_failures", ";").alias("sensitivity_failures"))


@query("l1_gate", f"SELECT {CKEY}, {dbl(*L1_D, *NEAR)}, trade_count, neighbor_count, layer1_pass, failure_reason FROM g1_gate", G1)
def l1_gate(spark, d):
    out = oos.gate(stored_daily(spark, d), FAMILY, PARENTS, SPLIT)
    return out.select(*CK, *L1_D, *NEAR, "trade_count", "neighbor_count", "layer1_pass", "failure_reason")


# --- gate 2 --------------------------------------------------------------------------
cte(
    "wf_folds",
    """SELECT symbol, CAST(k AS INTEGER) AS fold, first + (k - 1) * INTERVAL 182 DAY AS train_start, first + (k - 1) * INTERVAL 182 DAY + INTERVAL 728 DAY AS train_end,
  first + (k - 1) * INTERVAL 182 DAY + INTERVAL 728 DAY AS test_start, first + (k - 1) * INTERVAL 182 DAY + INTERVAL 910 DAY AS test_end
FROM (SELECT symbol, min(ts) AS first, max(ts) AS last FROM bars_d GROUP BY 1), range(1, 1000) r(k)
WHERE first + (k - 1) * INTERVAL 182 DAY + INTERVAL 910 DAY <= last""",
)
cte(
    "wf_bars",
    """SELECT b.*, part, fold, row_number() OVER (PARTITION BY b.symbol, part, fold ORDER BY b.ts) - 1 AS fb FROM daily_no b JOIN (
  SELECT symbol, fold, 'train' AS part, train_start AS a, train_end AS z FROM wf_folds UNION ALL SELECT symbol, fold, 'test', test_start, test_end FROM wf_folds) f
ON f.symbol = b.symbol AND b.ts >= f.a AND b.ts < f.z""",
)
FK = f"{CKEY}, part, fold"


def gate2_ctes(tag: str, family: str) -> dict[str, str]:
    p = FOLDS
    out = plan_tables(tag, family, include_self=True)
    if family == "trend_sma":
        plan, _ = variant_plan(family, REGISTRY[family].combinations(), True)
        arms = []
        for _, v in plan:
            n = int(v["window"])
            sma = f"CASE WHEN fb >= {n - 1} THEN avg(close) OVER (PARTITION BY symbol, part, fold ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
            arms.append(f"SELECT '{family}' AS family, symbol, ts, fb, part, fold, '{REGISTRY[family].candidate_key(v)}' AS params_key, CASE WHEN close > sma THEN 1 WHEN close < sma THEN -1 ELSE 0 END AS target FROM (SELECT *, {sma} AS sma FROM wf_bars)")
        out[f"{tag}_ft"] = " UNION ALL ".join(arms)
    else:
        out[f"{tag}_ft"] = f"SELECT t.family, t.symbol, t.ts, fb, part, fold, t.params_key, t.target FROM {tag}_t t JOIN wf_bars USING (symbol, ts)"
    out[f"{tag}_bt"] = ledger_sql(f"{tag}_ft", "daily_no", FK)
    out[f"{tag}_runs"] = runs_sql(f"{tag}_bt", FK, "fb = 0")
    out[f"{tag}_trades"] = trades_sql(f"{tag}_runs", FK)
    out[f"{tag}_nav"] = nav_sql(f"{tag}_bt", FK)
    out[f"{tag}_met"] = metrics_sql(f"{tag}_nav", f"{tag}_trades", FK)
    out[f"{tag}_sel"] = f"""SELECT * FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, fold, parent_key) AS eligible_n,
  row_number() OVER (PARTITION BY symbol, fold, parent_key ORDER BY ok DESC, CASE WHEN ok THEN -net_sharpe END NULLS LAST, CASE WHEN ok THEN abs(net_max_drawdown) END NULLS LAST,
    CASE WHEN ok THEN -net_total_return END NULLS LAST, CASE WHEN ok THEN trade_count END NULLS LAST, CASE WHEN ok THEN ord END NULLS LAST, params_key = parent_key DESC) AS r
FROM (SELECT m.*, parent_key, ord, trade_count >= {p.minimum_training_trades} AND net_sharpe IS NOT NULL AS ok FROM {tag}_met m JOIN {tag}_links USING (params_key) WHERE part = 'train')) WHERE r = 1"""
    out[f"{tag}_res"] = f"""SELECT s.family, s.symbol, s.fold, s.parent_key, s.params_key, s.eligible_n AS eligible_parameter_count, NOT s.ok AS fallback_selection_used,
  s.net_sharpe AS training_net_sharpe, s.trade_count AS training_trade_count, t.net_total_return AS test_net_return, t.net_sharpe AS test_net_sharpe,
  t.net_max_drawdown AS test_max_drawdown, t.trade_count AS test_trade_count
FROM {tag}_sel s JOIN {tag}_met t ON t.part = 'test' AND t.symbol = s.symbol AND t.fold = s.fold AND t.params_key = s.params_key"""
    PK = "family, symbol, parent_key"
    out[f"{tag}_cat"] = f"SELECT b.*, r.parent_key FROM {tag}_bt b JOIN {tag}_res r ON r.symbol = b.symbol AND r.fold = b.fold AND r.params_key = b.params_key WHERE b.part = 'test'"
    out[f"{tag}_cnav"] = nav_sql(f"{tag}_cat", PK)
    out[f"{tag}_cmet"] = metrics_sql(f"{tag}_cnav", f"(SELECT *, NULL::VARCHAR AS parent_key FROM {tag}_trades WHERE false)", PK)
    out[f"{tag}_agg"] = f"""SELECT m.family, m.symbol, m.parent_key AS params_key, m.net_sharpe AS walkforward_net_sharpe, m.net_total_return AS walkforward_net_total_return,
  m.net_max_drawdown AS walkforward_net_max_drawdown, m.total_transaction_cost AS walkforward_total_transaction_cost, m.observation_count AS walkforward_observation_count, f.* EXCLUDE (family, symbol, parent_key)
FROM {tag}_cmet m JOIN (SELECT family, symbol, parent_key, count(*) AS completed_folds, CAST(count_if(test_net_return > 0) AS BIGINT) AS positive_folds, CAST(sum(test_trade_count) AS BIGINT) AS total_test_trades,
  median(test_net_sharpe) AS median_window_sharpe, min(test_net_sharpe) AS worst_window_sharpe, max(test_net_sharpe) AS best_window_sharpe, median(test_net_return) AS median_window_return,
  min(test_net_return) AS worst_window_return, count(DISTINCT params_key) AS selection_unique_count, max(uses) / count(*) AS selection_mode_share, CAST(count_if(fallback_selection_used) AS BIGINT) AS fallback_fold_count,
  '{{' || string_agg('"' || fold || '":"' || params_key || '"', ',' ORDER BY CAST(fold AS VARCHAR)) || '}}' AS selected_by_fold, count_if(test_net_return > 0) / count(*) AS profitable_fold_share
  FROM (SELECT *, count(*) OVER (PARTITION BY symbol, parent_key, params_key) AS uses FROM {tag}_res) GROUP BY 1, 2, 3) f USING (family, symbol, parent_key)"""
    reasons = fails(
        maximum_drawdown=f"walkforward_net_max_drawdown >= {-p.maximum_drawdown}", minimum_completed_folds=f"completed_folds >= {p.minimum_completed_folds}",
        minimum_oos_return=f"walkforward_net_total_return > {p.minimum_return}", minimum_oos_sharpe=f"walkforward_net_sharpe >= {p.minimum_sharpe}",
        minimum_oos_trades=f"total_test_trades >= {p.minimum_trades}", minimum_profitable_fold_share=f"profitable_fold_share >= {p.minimum_profitable_fold_share}",
    )
    reasons = f"CASE WHEN completed_folds IS NULL THEN 'no_completed_folds' ELSE {reasons} END"
    listed = f"(SELECT '{family}' AS family, symbol, params_key FROM (SELECT DISTINCT symbol FROM daily_no), {tag}_parents) LEFT JOIN {tag}_agg USING (family, symbol, params_key)"
    out[f"{tag}_gate"] = f"SELECT *, {reasons} AS failure_reason, {reasons} = '' AS layer2_pass, split_part({reasons}, ';', 1) AS primary_failure_reason FROM {listed}"
    return out


G2 = gate2_ctes("g2", FAMILY)
FOLD_TIMES = ("train_start", "train_end", "test_start", "test_end")


@query("wf_windows", f"SELECT symbol, fold, {', '.join(FOLD_TIMES)} FROM wf_folds")
def wf_windows(spark, d):
    return walkforward.windows(stored_daily(spark, d), FOLDS)


@query("wf_slice", f"SELECT symbol, part, fold, ts, CAST(fb AS INTEGER) AS bar_no, {dbl('open', 'close', 'next_open')} FROM wf_bars")
def wf_slice(spark, d):
    return walkforward.slices(stored_daily(spark, d), FOLDS).select("symbol", "part", "fold", "ts", "bar_no", "open", "close", "next_open")


def _wf(spark, d):
    return walkforward.prepare(stored_daily(spark, d), FAMILY, PARENTS, FOLDS)


TRAIN_D = ("net_sharpe", "net_total_return", "net_max_drawdown")


def _fold_query(name: str, part: str) -> None:
    @query(name, f"SELECT {CKEY}, fold, trade_count, {dbl(*TRAIN_D)} FROM g2_met WHERE part = '{part}'", G2)
    def run(spark, d):
        segs, _, plan = _wf(spark, d)
        return named(walkforward.fold_metrics(segs, part), plan).select(*CK, "fold", "trade_count", *TRAIN_D)


_fold_query("wf_train_eval", "train")


@query("wf_select", f"SELECT family, symbol, parent_key, params_key, fold, CAST(eligible_n AS BIGINT) AS eligible_parameter_count, NOT ok AS fallback_selection_used, round(net_sharpe + 3.7e-8, 6) + 0.0 AS training_net_sharpe FROM g2_sel", G2)
def wf_select(spark, d):
    segs, links, plan = _wf(spark, d)
    chosen = walkforward.select(walkforward.fold_metrics(segs, "train"), links, FOLDS)
    keys = [REGISTRY[f].candidate_key(p) for f, p in plan]
    parent = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("parent") + 1)
    return named(chosen, plan).select(*CK, parent.alias("parent_key"), "fold", "eligible_parameter_count", "fallback_selection_used", "training_net_sharpe")


TEST_D = ("training_net_sharpe", "test_net_return", "test_net_sharpe", "test_max_drawdown")


@query("wf_test_eval", f"SELECT family, symbol, parent_key, params_key, fold, {dbl(*TEST_D)}, test_trade_count FROM g2_res", G2)
def wf_test_eval(spark, d):
    segs, links, plan = _wf(spark, d)
    keys = [REGISTRY[f].candidate_key(p) for f, p in plan]
    parent = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("parent") + 1)
    return named(walkforward.fold_results(segs, links, FOLDS), plan).select(*CK, parent.alias("parent_key"), "fold", *TEST_D, "test_trade_count")


AGG_D = ("walkforward_net_sharpe", "walkforward_net_total_return", "walkforward_net_max_drawdown", "walkforward_total_transaction_cost",
         "median_window_sharpe", "worst_window_sharpe", "best_window_sharpe", "median_window_return", "worst_window_return", "selection_mode_share", "profitable_fold_share")
AGG_I = ("walkforward_observation_count", "completed_folds", "positive_folds", "total_test_trades", "selection_unique_count", "fallback_fold_count")


@query("wf_aggregate", f"SELECT {CKEY}, {dbl(*AGG_D)}, {', '.join(AGG_I)}, selected_by_fold FROM g2_gate", G2)
def wf_aggregate(spark, d):
    return walkforward.gate(stored_daily(spark, d), FAMILY, PARENTS, FOLDS).select(*CK, *AGG_D, *AGG_I, "selected_by_fold")


@query("l2_gate", f"SELECT {CKEY}, {dbl('walkforward_net_sharpe', 'walkforward_net_total_return')}, layer2_pass, failure_reason, primary_failure_reason FROM g2_gate", G2)
def l2_gate(spark, d):
    out = walkforward.gate(stored_daily(spark, d), FAMILY, PARENTS, FOLDS)
    return out.select(*CK, "walkforward_net_sharpe", "walkforward_net_total_return", "layer2_pass", "failure_reason", "primary_failure_reason")


# --- gate 3 --------------------------------------------------------------------------
cte("day_open", "SELECT symbol, date_trunc('day', ts) AS day, arg_min(open, ts) AS open FROM bars_d GROUP BY 1, 2")
cte("day_ret", "SELECT * FROM (SELECT *, open / lag(open) OVER (PARTITION BY symbol ORDER BY day) - 1 AS daily_return FROM day_open) WHERE daily_return IS NOT NULL")
cte(
    "day_roll",
    """SELECT * FROM (SELECT *, CASE WHEN count(*) OVER w = 30 THEN product(1 + daily_return) OVER w - 1 END AS rolling_return FROM day_ret
WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE rolling_return IS NOT NULL""",
)
_APART = "(d.day < {0}.day - INTERVAL 59 DAY OR d.day - INTERVAL 29 DAY > {0}.day + INTERVAL 30 DAY + INTERVAL 86399 SECOND)"
cte("worst1", "SELECT symbol, arg_min(day, (rolling_return, day)) AS day, min(rolling_return) AS r FROM day_roll GROUP BY 1")
cte("worst2", f"SELECT d.symbol, arg_min(d.day, (rolling_return, d.day)) AS day, min(rolling_return) AS r FROM day_roll d JOIN worst1 a USING (symbol) WHERE {_APART.format('a')} GROUP BY 1")
cte("worst3", f"SELECT d.symbol, arg_min(d.day, (rolling_return, d.day)) AS day, min(rolling_return) AS r FROM day_roll d JOIN worst1 a USING (symbol) JOIN worst2 b USING (symbol) WHERE {_APART.format('a')} AND {_APART.format('b')} GROUP BY 1")
cte(
    "worst_all",
    " UNION ALL ".join(
        f"SELECT symbol, 'worst_market_window_{i}' AS stress_id, 'worst_market_window' AS stress_type, day - INTERVAL 29 DAY AS stress_start, day + INTERVAL 86399 SECOND AS stress_end, r AS market_return FROM worst{i}"
        for i in (1, 2, 3)
    ),
)
cte(
    "stress_win",
    f"""SELECT * FROM worst_all UNION ALL SELECT DISTINCT symbol, 'fixed', 'fixed_historical', TIMESTAMP '{STRESS.fixed_start}', TIMESTAMP '{STRESS.fixed_end}', NULL::DOUBLE FROM bars_d""",
)
SM_D = stress.METRICS[1:]
SK = f"{CKEY}, stress_id"


def gate3_ctes(tag: str, family: str) -> dict[str, str]:
    s = STRESS
    out = dict(signal_ctes(family, None, tag))
    out[f"{tag}_bt"] = ledger_sql(f"{tag}_t", "daily_no")
    out[f"{tag}_in"] = f"SELECT b.*, stress_id, stress_type FROM {tag}_bt b JOIN stress_win w ON w.symbol = b.symbol AND b.ts BETWEEN w.stress_start AND w.stress_end"
    out[f"{tag}_nav"] = nav_sql(f"{tag}_in", SK + ", stress_type", ("net",))
    none = lambda keys: f"(SELECT {keys}, 0.0 AS net_trade_return, 0.0 AS holding_hours FROM {tag}_in WHERE false)"
    short = ", ".join(f"CASE WHEN observation_count >= 2 THEN {c} END AS {c}" for c in SM_D)
    out[f"{tag}_hist"] = f"SELECT {SK}, stress_type, observation_count, {short} FROM ({metrics_sql(f'{tag}_nav', none(SK + ', stress_type'), SK + ', stress_type', '', ('net',))})"
    out[f"{tag}_syn"] = f"""SELECT * REPLACE (gross_return * {s.return_multiplier} AS gross_return, spread_cost * {s.spread_multiplier} AS spread_cost,
  spread_cost * {s.spread_multiplier} + commission_cost AS transaction_cost, gross_return * {s.return_multiplier} - (spread_cost * {s.spread_multiplier} + commission_cost) AS net_return) FROM {tag}_bt"""
    out[f"{tag}_snav"] = nav_sql(f"{tag}_syn", CKEY, ("net",))
    out[f"{tag}_smet"] = metrics_sql(f"{tag}_snav", none(CKEY), CKEY, "", ("net",))
    out[f"{tag}_j"] = f"""SELECT y.family, y.symbol, y.params_key, y.net_total_return AS synthetic_net_total_return, y.net_max_drawdown AS synthetic_net_max_drawdown, y.terminal_nav AS synthetic_terminal_nav,
  any_value(first_ts) > TIMESTAMP '{s.fixed_end}' AS na, count(h.stress_id) FILTER (WHERE stress_id <> 'fixed') AS nw,
  max(CASE WHEN stress_id = 'fixed' THEN h.net_total_return END) AS fixed_net_return, max(CASE WHEN stress_id = 'fixed' THEN h.net_max_drawdown END) AS fixed_max_drawdown,
  min(CASE WHEN stress_id <> 'fixed' THEN h.net_total_return END) AS worst_historical_net_return, min(CASE WHEN stress_id <> 'fixed' THEN h.net_max_drawdown END) AS worst_historical_max_drawdown
FROM {tag}_smet y LEFT JOIN {tag}_hist h USING ({CKEY}) LEFT JOIN (SELECT symbol, min(ts) AS first_ts FROM daily_no GROUP BY 1) f ON f.symbol = y.symbol
GROUP BY y.family, y.symbol, y.params_key, y.net_total_return, y.net_max_drawdown, y.terminal_nav"""
    reasons = fails(
        fixed_net_return=f"na OR fixed_net_return >= {s.minimum_fixed_return}", fixed_drawdown=f"na OR fixed_max_drawdown >= {-s.maximum_fixed_drawdown}",
        missing_worst_market_windows=f"nw >= {s.window_count}", worst_window_net_return=f"nw = 0 OR worst_historical_net_return >= {s.minimum_worst_return}",
        worst_window_drawdown=f"nw = 0 OR worst_historical_max_drawdown >= {-s.maximum_worst_drawdown}", synthetic_total_return=f"synthetic_net_total_return >= {s.minimum_synthetic_return}",
        synthetic_drawdown=f"synthetic_net_max_drawdown >= {-s.maximum_synthetic_drawdown}", synthetic_terminal_nav=f"synthetic_terminal_nav >= {s.minimum_synthetic_nav}",
    )
    out[f"{tag}_gate"] = f"SELECT *, {reasons} AS failure_reason, {reasons} = '' AS layer3_pass FROM {tag}_j"
    return out


G3 = gate3_ctes("g3", FAMILY)
G3_PLAN = [(FAMILY, p) for p in PARENTS]


@query("daily_returns", f"SELECT symbol, day, {dbl('open', 'daily_return')} FROM day_ret")
def daily_returns(spark, d):
    return stress.daily_returns(stored_daily(spark, d))


@query("rolling_compound", f"SELECT symbol, day, {dbl('rolling_return')} FROM day_roll")
def rolling_compound(spark, d):
    return stress.rolling_compound(stress.daily_returns(stored_daily(spark, d))).select("symbol", "day", "rolling_return")


@query("worst_windows", f"SELECT symbol, stress_id, stress_type, stress_start, stress_end, {dbl('market_return')} FROM worst_all")
def worst_windows(spark, d):
    return stress.worst_windows(stress.rolling_compound(stress.daily_returns(stored_daily(spark, d))), STRESS)


@query("stress_windows", f"SELECT symbol, stress_id, stress_type, stress_start, stress_end, {dbl('market_return')} FROM stress_win")
def stress_windows(spark, d):
    return stress.stress_windows(stored_daily(spark, d), STRESS)


def g3_parts(bars, plan=G3_PLAN):
    book = bt.ledger(positions(bars, plan))
    return stress.stress_metrics(book, stress.stress_windows(bars, STRESS)), stress.synthetic(book, STRESS)


@query("stress_metrics", f"SELECT {SK}, stress_type, observation_count, {dbl(*SM_D)} FROM g3_hist", G3)
def stress_metrics(spark, d):
    return named(g3_parts(stored_daily(spark, d))[0], G3_PLAN).select(*CK, "stress_id", "stress_type", "observation_count", *SM_D)


SYN_D = ("net_total_return", "net_sharpe", "net_max_drawdown", "terminal_nav", "worst_bar_return", "total_spread_cost", "total_commission_cost", "total_transaction_cost")


@query("synthetic_stress", f"SELECT {CKEY}, {dbl(*SYN_D)} FROM g3_smet", G3)
def synthetic_stress(spark, d):
    return named(g3_parts(stored_daily(spark, d))[1], G3_PLAN).select(*CK, *SYN_D)


L3_D = ("fixed_net_return", "fixed_max_drawdown", "worst_historical_net_return", "worst_historical_max_drawdown",
        "synthetic_net_total_return", "synthetic_net_max_drawdown", "synthetic_terminal_nav")


@query("l3_gate", f"SELECT {CKEY}, {dbl(*L3_D)}, layer3_pass, failure_reason FROM g3_gate", G3)
def l3_gate(spark, d):
    bars = stored_daily(spark, d)
    return named(stress.judge(*g3_parts(bars), bars, STRESS), G3_PLAN).select(*CK, *L3_D, "layer3_pass", "failure_reason")


# --- gate 4 (carry: few, long trades) ------------------------------------------------
L4_FAMILY = "carry"
L4_PLAN = [(L4_FAMILY, p) for p in REGISTRY[L4_FAMILY].combinations()]
HEX = lambda text: f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"
LABEL = "concat_ws('__', family, symbol, params_key)"


def gate4_ctes(tag: str, family: str, r: resample.Resampling = TRIALS) -> dict[str, str]:
    out = {**signal_ctes(family, None, tag), **chain(tag, f"{tag}_t", "daily_no")}
    out[f"{tag}_pn"] = f"SELECT {CKEY}, n, ppy, obs, unnest(range(1, {r.permutations} + 1)) AS j FROM (SELECT {CKEY}, count(*) AS n, count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 31557600.0) AS ppy, CASE WHEN stddev_samp(net_return) > 1e-15 THEN avg(net_return) / stddev_samp(net_return) * sqrt(count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 31557600.0)) END AS obs FROM {tag}_bt GROUP BY {CKEY})"
    shift_text = LABEL + " || '#shift#' || j"
    out[f"{tag}_ps"] = f"SELECT *, 1 + {HEX(shift_text)} % (n - 1) AS shift FROM {tag}_pn"
    out[f"{tag}_pp"] = f"""SELECT s.family, s.symbol, s.params_key, s.j, s.obs, CASE WHEN stddev_samp(b.executed * m.r - b.transaction_cost) > 1e-12
  THEN avg(b.executed * m.r - b.transaction_cost) / stddev_samp(b.executed * m.r - b.transaction_cost) * sqrt(s.ppy) END AS x
FROM {tag}_ps s JOIN {tag}_bt b USING ({CKEY}) JOIN (SELECT symbol, bar_no, next_open / open - 1 AS r FROM daily_no WHERE next_open IS NOT NULL) m
  ON m.symbol = b.symbol AND m.bar_no = ((b.bar_no - s.shift) % s.n + s.n) % s.n GROUP BY 1, 2, 3, 4, 5, s.ppy"""
    out[f"{tag}_perm"] = f"""SELECT {CKEY}, obs AS observed_net_sharpe, count(x) AS permutation_count, avg(x) AS permutation_mean_sharpe, quantile_cont(x, 0.5) AS permutation_median_sharpe,
  quantile_cont(x, 0.95) AS permutation_sharpe_p95, CASE WHEN count(x) > 0 THEN (1 + count_if(x >= obs - 1e-9)) / (count(x) + 1) END AS permutation_p_value FROM {tag}_pp GROUP BY {CKEY}, obs"""
    draw_text = LABEL + " || '#boot#' || rep || '#' || slot"
    out[f"{tag}_bo"] = f"SELECT *, row_number() OVER (PARTITION BY {CKEY} ORDER BY trade_group) - 1 AS slot, count(*) OVER (PARTITION BY {CKEY}) AS n, min(net_trade_return) OVER (PARTITION BY {CKEY}) AS low FROM {tag}_trades"
    out[f"{tag}_bd"] = f"SELECT {CKEY}, n, slot, rep, {HEX(draw_text)} % n AS no FROM (SELECT *, unnest(range(1, {r.bootstraps} + 1)) AS rep FROM {tag}_bo WHERE low > -1)"
    out[f"{tag}_bp"] = f"""SELECT *, sum(g) OVER (PARTITION BY {CKEY}, rep ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav
FROM (SELECT d.*, ln(1 + o.net_trade_return) AS g FROM {tag}_bd d JOIN {tag}_bo o ON o.family = d.family AND o.symbol = d.symbol AND o.params_key = d.params_key AND o.slot = d.no)"""
    out[f"{tag}_br"] = f"""SELECT {CKEY}, rep, exp(sum(g)) - 1 AS total, abs(least(exp(min(down)) - 1, 0)) AS drawdown, count(*) AS n FROM (
SELECT *, nav - greatest(max(nav) OVER (PARTITION BY {CKEY}, rep ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS down FROM {tag}_bp) GROUP BY {CKEY}, rep"""
    out[f"{tag}_boot"] = f"""SELECT {CKEY}, count(*) AS bootstrap_count, max(n) AS bootstrap_trade_count, quantile_cont(total, 0.5) AS bootstrap_median_total_return, quantile_cont(total, 0.05) AS bootstrap_total_return_p05,
  quantile_cont(total, 0.95) AS bootstrap_total_return_p95, avg(CASE WHEN total < 0 THEN 1.0 ELSE 0.0 END) AS bootstrap_probability_negative_return, quantile_cont(drawdown, 0.5) AS bootstrap_median_max_drawdown,
  quantile_cont(drawdown, 0.95) AS bootstrap_drawdown_p95 FROM {tag}_br GROUP BY {CKEY}"""
    out[f"{tag}_mom"] = f"""SELECT {CKEY}, count(*) AS dsr_observation_count, CASE WHEN stddev_samp(net_return) > 1e-15 THEN avg(net_return) / stddev_samp(net_return) END AS dsr_period_sharpe,
  CASE WHEN stddev_samp(net_return) > 1e-15 THEN skewness(net_return) END AS dsr_skewness, CASE WHEN stddev_samp(net_return) > 1e-15 THEN kurtosis(net_return) + 3 END AS dsr_kurtosis FROM {tag}_bt GROUP BY {CKEY}"""
    return out


G4 = gate4_ctes("g4", L4_FAMILY)


def g4_book(spark, d):
    bars = stored_daily(spark, d, macro=True)
    return bars, bt.ledger(positions(bars, L4_PLAN))


@query("stable_draws", f"SELECT {CKEY}, CAST(j AS INTEGER) AS j, CAST(shift AS INTEGER) AS shift FROM g4_ps", G4)
def stable_draws(spark, d):
    _, book = g4_book(spark, d)
    n = named(book.groupBy("symbol", "cand").agg(F.count("*").alias("n")), L4_PLAN)
    j = n.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(TRIALS.permutations))))
    shift = 1 + resample.draw(resample.label(), F.lit("shift"), F.col("j").cast("string")) % (F.col("n") - 1)
    return j.select(*CK, "j", shift.cast("int").alias("shift"))


PERM_D = ("observed_net_sharpe", "permutation_mean_sharpe", "permutation_median_sharpe", "permutation_sharpe_p95", "permutation_p_value")


@query("perm_test", f"SELECT {CKEY}, permutation_count, {dbl(*PERM_D)} FROM g4_perm", G4)
def perm_test(spark, d):
    bars, book = g4_book(spark, d)
    return resample.permutation_test(materialize(named(book, L4_PLAN), "book"), bars, TRIALS.permutations)


BOOT_D = ("bootstrap_median_total_return", "bootstrap_total_return_p05", "bootstrap_total_return_p95", "bootstrap_probability_negative_return",
          "bootstrap_median_max_drawdown", "bootstrap_drawdown_p95")


@query("trade_bootstrap", f"SELECT {CKEY}, bootstrap_count, bootstrap_trade_count, {dbl(*BOOT_D)} FROM g4_boot", G4)
def trade_bootstrap(spark, d):
    _, book = g4_book(spark, d)
    rows = named(bt.trades(bt.runs(bt.segments(book))), L4_PLAN)
    return resample.trade_bootstrap(materialize(rows, "trades"), TRIALS.bootstraps)


DSR_D = ("dsr_period_sharpe", "dsr_skewness", "dsr_kurtosis")


@query("deflated_moments", f"SELECT {CKEY}, dsr_observation_count, {dbl(*DSR_D)} FROM g4_mom", G4)
def deflated_moments(spark, d):
    return resample.moments(named(g4_book(spark, d)[1], L4_PLAN))


def _dsr(spark, d, bars, book):
    """The trial count is the whole routed population of the run, not the tested part of it."""
    trials = cand.population(spark, universe(spark, d, bars)).agg(F.count("*").alias("trials"))
    return resample.deflated_sharpe(resample.moments(book), trials)


STAT = "(dsr_period_sharpe - dsr_benchmark_sharpe) / dsr_sharpe_standard_error"
DSR_E = ("dsr_sharpe_standard_error", "dsr_benchmark_sharpe", "test_statistic")


def gate4_verdict(tag: str) -> dict[str, str]:
    """Verdicts in SQL."""
    r = TRIALS
    spread = "(1 - dsr_skewness * dsr_period_sharpe + (dsr_kurtosis - 1) / 4 * dsr_period_sharpe * dsr_period_sharpe)"
    checks = fails(
        permutation_p_value=f"permutation_p_value < {r.maximum_p_value}", bootstrap_trade_count=f"bootstrap_trade_count >= {r.minimum_trades}",
        bootstrap_drawdown_p95=f"bootstrap_drawdown_p95 <= {r.maximum_drawdown_p95}",
        bootstrap_probability_negative_return=f"bootstrap_probability_negative_return < {r.maximum_probability_negative}",
        deflated_sharpe_probability=f"dsr_probability >= {r.minimum_dsr_probability}",
    )
    reasons = f"CASE WHEN bootstrap_count IS NULL THEN 'No valid trade returns available.' ELSE {checks} END"
    return {
        f"{tag}_dsr": f"SELECT *, {normal.distribution('test_statistic')} AS dsr_probability FROM (SELECT *, {STAT} AS test_statistic FROM (SELECT *, dsr_sharpe_standard_error * ({normal.expected_maximum('dsr_trial_count')}) AS dsr_benchmark_sharpe FROM (SELECT *, CASE WHEN {spread} > 0 THEN sqrt({spread} / (dsr_observation_count - 1)) END AS dsr_sharpe_standard_error FROM {tag}_mom CROSS JOIN (SELECT count(*) AS dsr_trial_count FROM population_t))))",
        f"{tag}_gate": f"SELECT *, {reasons} AS failure_reason, {reasons} = '' AS layer4_pass FROM {tag}_dsr LEFT JOIN {tag}_perm USING ({CKEY}) LEFT JOIN {tag}_boot USING ({CKEY})",
    }


G4V = {**G4, **gate4_verdict("g4")}


@query("deflated_sharpe", f"SELECT {CKEY}, {dbl(*DSR_E)} FROM g4_dsr", G4V)
def deflated_sharpe(spark, d):
    bars, book = g4_book(spark, d)
    return _dsr(spark, d, bars, named(book, L4_PLAN)).select(*CK, *DSR_E[:2], F.expr(STAT).alias("test_statistic"))


@query("deflated_probability", f"SELECT {CKEY}, dsr_trial_count, {dbl('dsr_probability')} FROM g4_dsr", G4V)
def deflated_probability(spark, d):
    bars, book = g4_book(spark, d)
    return _dsr(spark, d, bars, named(book, L4_PLAN)).select(*CK, "dsr_trial_count", "dsr_probability")


# Trial counts taken from the tables: candidates ever tested per priority and status.
@query("expected_max_sharpe", f"SELECT family, symbol, trials, {dbl('expected_max')} FROM (SELECT *, {normal.expected_maximum('trials')} AS expected_max FROM (SELECT family, symbol, count(DISTINCT candidate_id) AS trials FROM test_log GROUP BY 1, 2))")
def expected_max_sharpe(spark, d):
    n = event_rows(spark, d).groupBy("family", "symbol").agg(F.countDistinct("candidate_id").alias("trials"))
    return n.withColumn("expected_max", F.expr(normal.expected_maximum("trials")))


def l4_parts(spark, d, bars, book):
    rows = materialize(named(book, L4_PLAN), "book")
    found = materialize(named(bt.trades(bt.runs(bt.segments(book))), L4_PLAN), "trades")
    return resample.permutation_test(rows, bars, TRIALS.permutations), resample.trade_bootstrap(found, TRIALS.bootstraps), _dsr(spark, d, bars, rows)


@query("l4_gate", f"SELECT {CKEY}, {dbl(*PERM_D, *BOOT_D)}, bootstrap_trade_count, layer4_pass, failure_reason FROM g4_gate", G4V)
def l4_gate(spark, d):
    return resample.judge(*l4_parts(spark, d, *g4_book(spark, d))).select(*CK, *PERM_D, *BOOT_D, "bootstrap_trade_count", "layer4_pass", "failure_reason")


# --- all gates over one family -------------------------------------------------------
FUNNEL = {**gate1_ctes("f1", L4_FAMILY), **gate2_ctes("f2", L4_FAMILY), **gate3_ctes("f3", L4_FAMILY), **G4V}
CID = "family || '__' || symbol || '__' || params_key"


def gate_tables(spark, d):
    """Verdicts of all four gates over the carry candidates, from one stored table of bars."""
    bars, book = g4_book(spark, d)
    parents = REGISTRY[L4_FAMILY].combinations()
    cid = F.concat_ws("__", *CK).alias("candidate_id")
    l1 = oos.gate(bars, L4_FAMILY, parents, SPLIT).select(cid, "family", "symbol", "layer1_pass")
    l2 = walkforward.gate(bars, L4_FAMILY, parents, FOLDS).select(cid, "layer2_pass")
    l3 = named(stress.judge(*g3_parts(bars, L4_PLAN), bars, STRESS), L4_PLAN).select(cid, "layer3_pass")
    l4 = resample.judge(*l4_parts(spark, d, bars, book)).select(cid, "layer4_pass")
    return l1, l2, l3, l4


@query(
    "final_funnel",
    f"""SELECT candidate_id, family, symbol, layer1_pass, layer2_pass, layer3_pass, layer4_pass, layer1_pass AND layer2_pass AND layer3_pass AND layer4_pass AS final_pass
FROM (SELECT {CID} AS candidate_id, family, symbol, layer1_pass FROM f1_gate) JOIN (SELECT {CID} AS candidate_id, layer2_pass FROM f2_gate) USING (candidate_id)
JOIN (SELECT {CID} AS candidate_id, layer3_pass FROM f3_gate) USING (candidate_id) JOIN (SELECT {CID} AS candidate_id, layer4_pass FROM g4_gate) USING (candidate_id)""",
    FUNNEL,
)
def final_funnel(spark, d):
    return report.final_funnel(*gate_tables(spark, d))


# --- all gates over the whole population ---------------------------------------------
@query("population_funnel")
def population_funnel(spark, d):
    """No SQL: walk-forward folds of most families cannot be written as one statement. The gates' rules are checked family-wise above."""
    single = materialize(stored_daily(spark, d, macro=True), "numbered")
    series, pair = materialize(universe(spark, d, single), "universe"), materialize(stored_pairs(spark, d, single), "numbered")
    candidates = materialize(cand.population(spark, series).select("family", "symbol", "candidate_id"), "candidates")
    trials = candidates.agg(F.count("*").alias("trials"))
    return population.funnel(candidates, population.gate_tables(single, pair, series, trials, SPLIT, FOLDS, STRESS, TRIALS))
