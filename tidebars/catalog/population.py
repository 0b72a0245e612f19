"""Candidate population, neighbours and test history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.bars import event_rows
from tidebars.catalog.base import cte, query
from tidebars.operators import candidates as cand
from tidebars.operators import pairs, quality
from tidebars.plans.families import REGISTRY
from tidebars.session import materialize
from tidebars.sources import ticks


def universe(spark, d, bars=None):
    """Daily symbols with their instrument attributes, and the pairs that overlap; ``bars`` are stored daily bars, if there are any."""
    bars = materialize(ticks.daily_bars(spark, d).select("symbol", "ts", "close", "fill_spread_fraction"), "bars") if bars is None else bars
    dim = quality.instruments(spark).select("symbol", "sec_type", "what_to_show")
    single = bars.select("symbol").distinct().join(dim, "symbol").select("symbol", F.lit("single").alias("kind"), "sec_type", "what_to_show")
    pair = pairs.aligned_pairs(bars).select("symbol").distinct()
    return single.unionByName(pair.select("symbol", F.lit("pair").alias("kind")), allowMissingColumns=True)


def fmt(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE replace(replace(printf('%.6g', {x}), '.', 'p'), '-', 'm') END"


def _grid_sql() -> str:
    parts = []
    for name, spec in REGISTRY.items():
        cols = sorted(spec.grid)
        key = " || '__' || ".join(f"'{c}-' || {fmt(f'v_{c}')}" for c in cols)
        src = ", ".join(f"(SELECT unnest([{', '.join(f'CAST({v!r} AS DOUBLE)' for v in spec.grid[c])}]) AS v_{c})" for c in cols)
        parts.append(f"SELECT '{name}' AS family, '{spec.universe}' AS universe, {key} AS params_key FROM {src}")
    return " UNION ALL ".join(parts)


cte("grid_points", _grid_sql())
cte(
    "universe_t",
    """SELECT symbol, 'single' AS kind, sec_type, what_to_show FROM (SELECT DISTINCT symbol FROM bars_d) JOIN dimension USING (symbol)
UNION ALL SELECT DISTINCT symbol, 'pair', NULL, NULL FROM pair_rows""",
)
cte(
    "population_t",
    """SELECT family, symbol, params_key, family || '__' || symbol || '__' || params_key AS candidate_id FROM grid_points g JOIN universe_t u
ON CASE g.universe WHEN 'pairs' THEN u.kind = 'pair' WHEN 'cash' THEN u.kind = 'single' AND u.sec_type = 'CASH'
   WHEN 'real_volume' THEN u.kind = 'single' AND u.what_to_show = 'TRADES' ELSE u.kind = 'single' END""",
)


@query("grid_expand", "SELECT family, symbol, params_key FROM grid_points, (SELECT DISTINCT symbol FROM bars_d)")
def grid_expand(spark, d):
    symbols = ticks.daily_bars(spark, d).select("symbol").distinct()
    table = symbols.join(cand.families(spark).drop("universe"), F.lit(True))
    return cand.expand_grid(table).select("family", "symbol", cand.params_key().alias("params_key"))


@query("candidate_population", "SELECT family, symbol, params_key, candidate_id FROM population_t")
def candidate_population(spark, d):
    return cand.population(spark, universe(spark, d)).select("family", "symbol", "params_key", "candidate_id")


@query("candidates_by_family", "SELECT family, count(*) AS candidate_count, count(DISTINCT symbol) AS symbols FROM population_t GROUP BY 1")
def candidates_by_family(spark, d):
    pop = cand.population(spark, universe(spark, d))
    return pop.groupBy("family").agg(F.count("*").alias("candidate_count"), F.countDistinct("symbol").alias("symbols"))


# Ids of parameter sets taken from data: every part is a candidate.
@query(
    "candidate_id",
    f"""SELECT p_partkey, 'trend__' || p_brand || '__a_size-' || {fmt("CAST(p_size AS DOUBLE)")} || '__b_price-' || {fmt("round(p_retailprice / 7, 4)")} AS candidate_id FROM part""",
)
def candidate_id(spark, d):
    p = ticks.table(spark, d, "part")
    params = F.create_map(F.lit("b_price"), F.round(F.col("p_retailprice") / 7, 4), F.lit("a_size"), F.col("p_size").cast("double"))
    rows = p.select("p_partkey", F.lit("trend").alias("family"), F.col("p_brand").alias("symbol"), params.alias("params"))
    return cand.with_candidate_id(rows).select("p_partkey", "candidate_id")


@query(
    "candidate_rebuild",
    f"""SELECT p_partkey, 'momentum__' || p_brand || '__' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'lookback-' || p_size || '__' END || 'threshold-' || {fmt("(p_partkey % 5) / 4.0")} AS candidate_id,
  concat_ws(',', CASE WHEN p_size % 3 <> 0 THEN 'lookback' END, CASE WHEN p_partkey % 5 IN (0, 4) THEN 'threshold' END) AS int_params FROM part""",
)
def candidate_rebuild(spark, d):
    p = ticks.table(spark, d, "part")
    rows = p.select(
        "p_partkey", F.lit("momentum").alias("family"), F.col("p_brand").alias("symbol"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size")).cast("double").alias("lookback"),
        ((F.col("p_partkey") % 5) / 4).alias("threshold"),
    )
    return cand.rebuild(rows).select("p_partkey", "candidate_id", F.array_join("int_params", ",").alias("int_params"))


def _neighbor_sql() -> str:
    parts = []
    for name, spec in REGISTRY.items():
        cols = sorted(spec.grid)
        around = lambda v: (
            f"CASE WHEN {v} = floor({v}) THEN [greatest(1.0, round_even({v} * 0.8, 0)), {v}, greatest(1.0, round_even({v} * 1.2, 0))] "
            f"ELSE [round({v} * 0.8, 6), {v}, round({v} * 1.2, 6)] END"
        )
        src = ", ".join(f"(SELECT unnest([{', '.join(f'CAST({v!r} AS DOUBLE)' for v in spec.grid[c])}]) AS v_{c})" for c in cols)
        grid = f"(SELECT *, {', '.join(f'{around(f'v_{c}')} AS o_{c}' for c in cols)} FROM {src})"
        near = f"(SELECT {', '.join(f'g.v_{c} AS was_{c}, n_{c}.v AS v_{c}' for c in cols)} FROM {grid} g, {', '.join(f'(SELECT unnest(g.o_{c}) AS v) n_{c}' for c in cols)})"
        key = lambda pre: " || '__' || ".join(f"'{c}-' || {fmt(pre + c)}" for c in cols)
        moved = " OR ".join(f"was_{c} <> v_{c}" for c in cols)
        domain = " ".join(f"v_{w}" if w in spec.grid else w for w in spec.domain.split())
        parts.append(f"SELECT DISTINCT '{name}' AS family, {key('was_')} AS parent_key, {key('v_')} AS params_key FROM {near} WHERE ({moved}) AND {domain}")
    return " UNION ALL ".join(parts)


cte("near_points", _neighbor_sql())


@query(
    "param_neighbors",
    """SELECT p.candidate_id AS parent_id, n.family || '__' || p.symbol || '__' || n.params_key AS candidate_id
FROM population_t p JOIN near_points n ON n.family = p.family AND n.parent_key = p.params_key""",
)
def param_neighbors(spark, d):
    return cand.neighbors(cand.population(spark, universe(spark, d))).select("parent_id", "candidate_id")


NOW = "2000-01-01"


@query(
    "cooldown_due",
    f"""SELECT 'c' || c_custkey AS candidate_id, last AS last_tested_at, last IS NULL OR TIMESTAMP '{NOW}' >= last + INTERVAL 30 DAY AS due
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' GROUP BY 1) ON o_custkey = c_custkey""",
)
def cooldown_due(spark, d):
    pool = ticks.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("candidate_id"))
    history = event_rows(spark, d).filter(F.col("tested_at") < NOW)
    return cand.cooldown(pool, history, F.lit(NOW).cast("timestamp"))


@query("test_history", "SELECT * FROM test_log WHERE candidate_id = 'c7' ORDER BY tested_at DESC")
def test_history(spark, d):
    return cand.test_history(event_rows(spark, d), "c7")


@query("promote_new", "SELECT DISTINCT candidate_id FROM test_log WHERE final_pass AND candidate_id NOT IN (SELECT candidate_id FROM test_log WHERE tested_at < TIMESTAMP '1996-01-01')")
def promote_new(spark, d):
    rows = event_rows(spark, d)
    survivors = rows.filter("final_pass").select("candidate_id").distinct()
    return cand.promote(survivors, rows.filter(F.col("tested_at") < "1996-01-01"))


@query(
    "deployed_candidates",
    """SELECT 'c' || c_custkey AS candidate_id, c_mktsegment AS family, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS survived
FROM customer""",
)
def deployed_candidates(spark, d):
    c = ticks.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("family"))
    survivors = event_rows(spark, d).filter("final_pass").select("candidate_id").distinct()
    return cand.deployed_candidates(c, survivors, c)
