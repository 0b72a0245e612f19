"""Reports over result tables.

The result tables come from the orders: a customer is a candidate, the market segment its
family, the nation its symbol, and its order statistics stand for gate metrics. They grow
with the data as a large population of candidates would.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import cte, dbl, query
from tidebars.plans import report
from tidebars.session import materialize
from tidebars.sources import ticks

cte(
    "cust",
    """SELECT 'c' || c_custkey AS candidate_id, c_mktsegment AS family, n_name AS symbol, c_custkey, c_acctbal, n, a, s, lo, hi
FROM (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
R = {
    1: ("a > 200000", "oos_net_sharpe", "n >= 6", "oos_trade_count"),
    2: ("s < 160000", "minimum_oos_sharpe", "hi > 250000", "minimum_oos_return"),
    3: ("lo > 8000", "worst_window_drawdown", "hi < 495000", "synthetic_total_return"),
    4: ("c_custkey % 3 > 0", "permutation_p_value", "c_acctbal > 0", "bootstrap_drawdown_p95"),
}


def _reason(i: int) -> str:
    a, x, b, y = R[i]
    return f"concat_ws(';', CASE WHEN coalesce({a}, false) THEN NULL ELSE '{x}' END, CASE WHEN coalesce({b}, false) THEN NULL ELSE '{y}' END)"


EXTRA = {1: "a / 1e5 - 2 AS oos_net_sharpe", 2: "s / 1e5 - 1 AS walkforward_net_sharpe", 3: "lo / 1e4 AS synthetic_terminal_nav", 4: "n / 100.0 AS permutation_p_value"}
METRICS_SQL = "candidate_id, family, symbol, (a - 150000) / s AS net_sharpe, a / 1e6 - 0.2 AS net_annual_return, (lo - hi) / 1e6 AS net_max_drawdown, n AS trade_count"
cte("r_met", f"SELECT {METRICS_SQL} FROM cust")
for _i in R:
    cte(f"r_l{_i}", f"SELECT candidate_id, family, symbol, {_reason(_i)} AS failure_reason, {_reason(_i)} = '' AS layer{_i}_pass, {EXTRA[_i]} FROM cust")
cte(
    "r_fun",
    """SELECT candidate_id, l1.family, l1.symbol, layer1_pass, layer2_pass, layer3_pass, layer4_pass, layer1_pass AND layer2_pass AND layer3_pass AND layer4_pass AS final_pass
FROM r_l1 l1 JOIN r_l2 USING (candidate_id) JOIN r_l3 USING (candidate_id) JOIN r_l4 USING (candidate_id)""",
)
cte("r_reasons", " UNION ALL ".join(f"SELECT 'layer{i}' AS layer, family, unnest(string_split(failure_reason, ';')) AS failure_reason FROM r_l{i} WHERE NOT layer{i}_pass" for i in R))


class Results:
    def __init__(self, spark, d):
        o = ticks.table(spark, d, "orders").groupBy("o_custkey").agg(
            F.count("*").alias("n"), F.avg("o_totalprice").alias("a"), F.stddev_samp("o_totalprice").alias("s"),
            F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        )
        c = ticks.table(spark, d, "customer")
        nation = ticks.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
        cust = c.join(o, c.c_custkey == o.o_custkey).join(nation, c.c_nationkey == nation.n_nationkey).select(
            F.concat(F.lit("c"), "c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("family"), "symbol", "c_custkey", "c_acctbal", "n", "a", "s", "lo", "hi"
        )
        cust = materialize(cust, "results")
        self.metrics = cust.select(
            "candidate_id", "family", "symbol", ((F.col("a") - 150000) / F.nullif("s", F.lit(0.0))).alias("net_sharpe"),
            (F.col("a") / 1e6 - 0.2).alias("net_annual_return"), ((F.col("lo") - F.col("hi")) / 1e6).alias("net_max_drawdown"), F.col("n").alias("trade_count"),
        )
        self.layers = {
            f"layer{i}": cust.selectExpr(
                "candidate_id", "family", "symbol", f"{_reason(i)} AS failure_reason", f"{_reason(i)} = '' AS layer{i}_pass",
                EXTRA[i].replace("1e5", "1e5D").replace("1e4", "1e4D").replace("100.0", "100D"),
            )
            for i in R
        }
        self.funnel = report.final_funnel(*self.layers.values())


PASS = ", ".join(report.PASSES)


@query("funnel_table", f"SELECT candidate_id, family, symbol, {PASS}, final_pass FROM r_fun")
def funnel_table(spark, d):
    return Results(spark, d).funnel


@query("funnel_mismatches", "SELECT candidate_id, 1::BIGINT AS in_funnel, NULL::BIGINT AS in_metrics FROM r_fun JOIN r_met USING (candidate_id) WHERE trade_count < 5")
def funnel_mismatches(spark, d):
    r = Results(spark, d)
    return report.funnel_mismatches(r.funnel, r.metrics.filter("trade_count >= 5"))


SURV = ("net_sharpe", "net_annual_return", "net_max_drawdown", "oos_net_sharpe", "walkforward_net_sharpe", "synthetic_terminal_nav", "permutation_p_value")


def _survivors(r: Results):
    pick = lambda i, c: r.layers[f"layer{i}"].select("candidate_id", c)
    return report.survivors(
        r.funnel, r.metrics.drop("family", "symbol"), pick(1, "oos_net_sharpe"), pick(2, "walkforward_net_sharpe"),
        pick(3, "synthetic_terminal_nav"), pick(4, "permutation_p_value"),
    )


cte("r_surv", "SELECT * FROM r_fun JOIN r_met USING (candidate_id, family, symbol) JOIN r_l1 USING (candidate_id, family, symbol, layer1_pass) JOIN (SELECT * EXCLUDE (failure_reason) FROM r_l2) USING (candidate_id, family, symbol, layer2_pass) JOIN (SELECT * EXCLUDE (failure_reason) FROM r_l3) USING (candidate_id, family, symbol, layer3_pass) JOIN (SELECT * EXCLUDE (failure_reason) FROM r_l4) USING (candidate_id, family, symbol, layer4_pass) WHERE final_pass")


@query("final_survivors", f"SELECT candidate_id, family, symbol, trade_count, {dbl(*SURV)} FROM r_surv")
def final_survivors(spark, d):
    return _survivors(Results(spark, d)).select("candidate_id", "family", "symbol", "trade_count", *SURV)


CUM = [("Generated", "true"), ("Layer 1", "layer1_pass"), ("Layer 2", "layer1_pass AND layer2_pass"), ("Layer 3", "layer1_pass AND layer2_pass AND layer3_pass"), ("Layer 4", "layer1_pass AND layer2_pass AND layer3_pass AND layer4_pass")]


@query("cumulative_funnel", " UNION ALL ".join(f"SELECT '{s}' AS stage, CAST(count_if({c}) AS BIGINT) AS survivors FROM r_fun" for s, c in CUM))
def cumulative_funnel(spark, d):
    return report.cumulative_funnel(Results(spark, d).funnel)


@query(
    "gate_summary",
    " UNION ALL ".join(
        f"SELECT 'Layer {i}' AS layer, CAST(count_if(layer{i}_pass) AS BIGINT) AS independent_passes, CAST(count_if(NOT layer{i}_pass) AS BIGINT) AS independent_failures, "
        f"round(avg(CASE WHEN layer{i}_pass THEN 1.0 ELSE 0.0 END) + 3.7e-8, 6) + 0.0 AS independent_pass_rate FROM r_fun" for i in R
    ),
)
def gate_summary(spark, d):
    return report.gate_summary(Results(spark, d).funnel)


@query("failure_summary", "SELECT layer, failure_reason, count(*) AS candidate_failures FROM r_reasons WHERE failure_reason <> '' GROUP BY 1, 2")
def failure_summary(spark, d):
    return report.failure_summary(Results(spark, d).layers)


@query(
    "family_symbol",
    f"""SELECT family, symbol, count(*) AS candidate_count, round(median(net_sharpe) + 3.7e-8, 6) + 0.0 AS median_full_sample_sharpe,
{', '.join(f'CAST(count_if(layer{i}_pass) AS BIGINT) AS layer{i}_passes' for i in R)}, CAST(count_if(final_pass) AS BIGINT) AS final_survivors FROM r_met JOIN r_fun USING (candidate_id, family, symbol) GROUP BY 1, 2""",
)
def family_symbol(spark, d):
    r = Results(spark, d)
    return report.family_symbol(r.metrics, r.funnel)


@query(
    "report_summary",
    """SELECT count(*) AS official_candidate_count, CAST(count_if(final_pass) AS BIGINT) AS final_survivor_count, round(count_if(final_pass) / count(*) + 3.7e-8, 6) + 0.0 AS final_survival_rate,
  (SELECT candidate_id FROM r_met WHERE net_sharpe IS NOT NULL ORDER BY net_sharpe DESC, candidate_id DESC LIMIT 1) AS best_full_sample_candidate,
  round((SELECT max(net_sharpe) FROM r_met) + 3.7e-8, 6) + 0.0 AS best_full_sample_net_sharpe FROM r_fun""",
)
def report_summary(spark, d):
    r = Results(spark, d)
    return report.report_summary(r.metrics, r.funnel)


@query(
    "top_candidates",
    f"""SELECT candidate_id, printf('%.1f%%', net_annual_return * 100) AS net_annual_return, coalesce(printf('%.2f', net_sharpe), '') AS net_sharpe,
  printf('%.1f%%', net_max_drawdown * 100) AS net_max_drawdown, trade_count, {PASS}, final_pass FROM r_met JOIN r_fun USING (candidate_id, family, symbol)
ORDER BY r_met.net_sharpe DESC NULLS LAST, candidate_id LIMIT 10""",
)
def top_candidates(spark, d):
    r = Results(spark, d)
    return report.top_candidates(r.metrics, r.funnel)


# Figures are printed from nine decimals, so that the order in which a mean was summed decides no tie; an undefined Sharpe is empty.
SHOWN = {"net_annual_return": ("%.1f%%", 100), "net_max_drawdown": ("%.1f%%", 100), "net_sharpe": ("%.3f", 1), "oos_net_sharpe": ("%.3f", 1), "permutation_p_value": ("%.3f", 1)}


@query(
    "survivor_table",
    f"""SELECT 'survivor' AS result, candidate_id, {', '.join(f"CASE WHEN isfinite({c}) THEN printf('{p}', round({c} * {m}, {report.KEPT_DECIMALS}) + 0.0) ELSE '' END AS {c}" for c, (p, m) in SHOWN.items())} FROM r_surv
UNION ALL SELECT 'No candidate passed all four validation layers.', {', '.join(['NULL'] * (1 + len(SHOWN)))} WHERE NOT EXISTS (SELECT * FROM r_surv)""",
)
def survivor_table(spark, d):
    return report.survivor_table(_survivors(Results(spark, d)), ["net_annual_return", "net_max_drawdown"], ["net_sharpe", "oos_net_sharpe", "permutation_p_value"])


@query(
    "family_status",
    """SELECT family, candidate_count, family <> 'MACHINERY' AS enabled, coalesce(v, 0) AS validated_count, coalesce(p, 0) AS deployed_count,
  CASE WHEN family = 'MACHINERY' THEN 'disabled' WHEN coalesce(p, 0) > 0 THEN 'deployed' WHEN coalesce(v, 0) > 0 THEN 'validated' ELSE 'candidate' END AS status
FROM (SELECT family, count(*) AS candidate_count FROM r_met GROUP BY 1) LEFT JOIN (SELECT family, count(*) AS v FROM r_fun WHERE final_pass GROUP BY 1) USING (family)
LEFT JOIN (SELECT family, count(*) AS p FROM r_fun WHERE final_pass AND symbol = 'CHINA' GROUP BY 1) USING (family)""",
)
def family_status(spark, d):
    r = Results(spark, d)
    found = r.funnel.filter("final_pass")
    families = r.metrics.groupBy("family").agg(F.count("*").alias("candidate_count")).withColumn("enabled", F.col("family") != "MACHINERY")
    return report.family_status(families, found, found.filter("symbol = 'CHINA'"))


cte(
    "r_export",
    f"""SELECT f.*, net_sharpe, net_max_drawdown, net_annual_return, coalesce(nullif(a.failure_reason, ''), nullif(b.failure_reason, ''), nullif(c.failure_reason, ''), nullif(e.failure_reason, '')) AS failure_reason
FROM r_fun f LEFT JOIN r_met USING (candidate_id) LEFT JOIN r_l1 a USING (candidate_id) LEFT JOIN r_l2 b USING (candidate_id) LEFT JOIN r_l3 c USING (candidate_id) LEFT JOIN r_l4 e USING (candidate_id)""",
)
EXPORT_D = ("net_sharpe", "net_max_drawdown", "net_annual_return")


@query("validation_export", f"SELECT candidate_id, family, symbol, {PASS}, final_pass, failure_reason, {dbl(*EXPORT_D)} FROM r_export")
def validation_export(spark, d):
    r = Results(spark, d)
    return report.validation_export(r.funnel, r.metrics, r.layers)


@query("top_reasons", "SELECT failure_reason, count(*) AS candidate_failures FROM r_reasons WHERE failure_reason <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_reasons(spark, d):
    return report.top_reasons(Results(spark, d).layers)


@query(
    "sharpe_histogram",
    """SELECT family, CAST(least(floor(coalesce((net_sharpe - lo) / nullif(hi - lo, 0), 0.5) * 12), 11) AS INTEGER) AS bin, count(*) AS candidates
FROM r_met JOIN (SELECT family, min(net_sharpe) AS lo, max(net_sharpe) AS hi FROM r_met GROUP BY 1) USING (family) WHERE net_sharpe IS NOT NULL GROUP BY 1, 2""",
)
def sharpe_histogram(spark, d):
    return report.sharpe_histogram(Results(spark, d).metrics)


@query("oos_vs_wf", f"SELECT candidate_id, {dbl('oos_net_sharpe', 'walkforward_net_sharpe')} FROM r_l1 JOIN r_l2 USING (candidate_id) WHERE oos_net_sharpe IS NOT NULL AND walkforward_net_sharpe IS NOT NULL")
def oos_vs_wf(spark, d):
    r = Results(spark, d)
    return report.oos_vs_walkforward(r.layers["layer1"], r.layers["layer2"])


@query(
    "gate_pass_rates",
    " UNION ALL ".join(f"SELECT '{g}' AS gate, round(avg(CASE WHEN {g} THEN 1.0 ELSE 0.0 END) * 100 + 3.7e-8, 6) + 0.0 AS pass_rate FROM r_fun" for g in [*report.PASSES, "final_pass"]),
)
def gate_pass_rates(spark, d):
    return report.gate_pass_rates(Results(spark, d).funnel)


@query("top_validation_table", f"SELECT candidate_id, family, symbol, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for c in EXPORT_D)}, final_pass, failure_reason FROM r_export ORDER BY r_export.net_sharpe DESC NULLS LAST, candidate_id LIMIT 15")
def top_validation_table(spark, d):
    r = Results(spark, d)
    return report.top_table(report.validation_export(r.funnel, r.metrics, r.layers))
