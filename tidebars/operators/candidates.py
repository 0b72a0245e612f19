"""Candidate populations: grids, routing, ids, neighbours, test history."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tidebars.functions.indicators import num
from tidebars.plans.families import REGISTRY, Family, Params

PERTURBATION = 0.2
COOLDOWN_DAYS = 30


def families(spark: SparkSession) -> DataFrame:
    """One row per family: universe, value lists per parameter, domain."""
    rows = [
        (name, spec.universe, {k: [float(x) for x in v] for k, v in spec.grid.items()})
        for name, spec in REGISTRY.items()
    ]
    return F.broadcast(spark.createDataFrame(rows, "family string, universe string, options map<string,array<double>>"))


def combinations(options: Column | str) -> Column:
    """All ways to pick one value per parameter, as an array of maps."""
    name = options if isinstance(options, str) else "options"
    return F.expr(
        f"aggregate(map_entries({name}), array(cast(map() as map<string,double>)), "
        "(acc, e) -> flatten(transform(acc, m -> transform(e.value, v -> map_concat(m, map(e.key, v))))))"
    )


def expand_grid(table: DataFrame) -> DataFrame:
    return table.select(*[c for c in table.columns if c != "options"], F.explode(combinations("options")).alias("params"))


def format_value(x: str) -> str:
    """SQL: a parameter value as it appears in candidate ids: whole numbers as they are, others with six significant digits.

    The same text as ``num`` gives in Python.
    """
    short = f"regexp_replace(regexp_replace(format_string('%.6g', {x}), '0+(e|$)', '$1'), '[.](e|$)', '$1')"
    return f"if({x} = floor({x}), cast(cast({x} as bigint) as string), replace(replace({short}, '.', 'p'), '-', 'm'))"


def params_key(params: str = "params") -> Column:
    """Parameters in name order: ``name-value__name-value``."""
    return F.expr(
        f"array_join(transform(array_sort(map_entries({params})), e -> concat(e.key, '-', {format_value('e.value')})), '__')"
    )


def with_candidate_id(df: DataFrame) -> DataFrame:
    return df.withColumn("params_key", params_key()).withColumn("candidate_id", F.concat_ws("__", "family", "symbol", "params_key"))


def tradable(universe: Column) -> Column:
    """Whether a series (kind, sec_type, what_to_show) belongs to the universe of a family."""
    c = F.col
    single = c("kind") == "single"
    return (
        F.when(universe == "pairs", c("kind") == "pair")
        .when(universe == "cash", single & (c("sec_type") == "CASH"))
        .when(universe == "real_volume", single & (c("what_to_show") == "TRADES"))
        .otherwise(single)
    )


def population(spark: SparkSession, universe: DataFrame) -> DataFrame:
    """Every grid point on every series its family may trade.

    ``universe``: symbol, kind (``single`` or ``pair``), sec_type, what_to_show.
    """
    pool = universe.join(families(spark), tradable(F.col("universe"))).select("family", "symbol", "options")
    return with_candidate_id(expand_grid(pool))


def rebuild(records: DataFrame) -> DataFrame:
    """Candidates from wide records: null parameters dropped, whole numbers are integers."""
    known = {k for spec in REGISTRY.values() for k in spec.grid}
    names = sorted(c for c in records.columns if c in known)
    entries = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    kept = records.withColumn("params", F.map_filter(entries, lambda k, v: v.isNotNull())).drop(*names)
    whole = F.expr("map_keys(map_filter(params, (k, v) -> v = floor(v)))")
    return with_candidate_id(kept.withColumn("int_params", F.array_sort(whole)))


def neighbors(candidates: DataFrame, perturbation: float = PERTURBATION) -> DataFrame:
    """Parameter sets up to 20 % away in any parameter, inside each family's domain."""
    lo, hi = 1 - perturbation, 1 + perturbation
    options = (
        "map_from_entries(transform(map_entries(params), e -> struct(e.key, if(e.value = floor(e.value), "
        f"array_distinct(array(greatest(1D, bround(e.value * {lo}D, 0)), e.value, greatest(1D, bround(e.value * {hi}D, 0)))), "
        f"array_distinct(array(round(e.value * {lo}D, 6), e.value, round(e.value * {hi}D, 6)))))))"
    )
    near = (
        candidates.select("family", "symbol", F.col("candidate_id").alias("parent_id"), F.col("params").alias("origin"), F.expr(options).alias("options"))
        .select("family", "symbol", "parent_id", "origin", F.explode(combinations("options")).alias("params"))
        .filter(F.expr("array_sort(map_entries(params)) <> array_sort(map_entries(origin))"))
        .filter(in_domain())
    )
    return with_candidate_id(near.drop("origin")).dropDuplicates(["parent_id", "candidate_id"])


def in_domain() -> Column:
    """Whether a row's parameters lie in its family's domain."""
    out = F.lit(False)
    for name, spec in REGISTRY.items():
        text = " ".join(f"params['{w}']" if w in spec.grid else w for w in spec.domain.split())
        out = F.when(F.col("family") == name, F.expr(text)).otherwise(out)
    return out


def valid(spec: Family, params: Params) -> bool:
    return bool(eval(spec.domain.replace("AND", "and"), {"__builtins__": {}}, dict(params)))


def near_params(family: str, params: Params, perturbation: float = PERTURBATION) -> list[Params]:
    """The neighbours of one parameter set, for planning a run (configuration size)."""
    spec = REGISTRY[family]

    def around(v: float) -> list[float]:
        if float(v).is_integer():
            return sorted({max(1, round(v * (1 - perturbation))), int(v), max(1, round(v * (1 + perturbation)))})
        return sorted({round(v * (1 - perturbation), 6), v, round(v * (1 + perturbation), 6)})

    names = sorted(params)
    found = {}
    for values in product(*[around(params[n]) for n in names]):
        near = dict(zip(names, values))
        if any(near[n] != params[n] for n in names) and valid(spec, near):
            found[spec.candidate_key(near)] = near
    return list(found.values())


def variant_plan(family: str, parents: list[Params], include_self: bool) -> tuple[list[tuple[str, Params]], list[tuple[int, int, int]]]:
    """Distinct parameter sets to run, and (parent, variant, order of parameters) links."""
    spec = REGISTRY[family]
    pool: dict[str, Params] = {}
    links = []
    for params in parents:
        pool.setdefault(spec.candidate_key(params), params)
    sets = [[p, *near_params(family, p)] if include_self else near_params(family, p) for p in parents]
    for group in sets:
        for params in group:
            pool.setdefault(spec.candidate_key(params), params)
    keys = list(pool)
    by_value = sorted(keys, key=lambda k: [float(pool[k][n]) for n in sorted(pool[k])])
    for params, group in zip(parents, sets):
        for near in group:
            k = spec.candidate_key(near)
            links.append((keys.index(spec.candidate_key(params)), keys.index(k), by_value.index(k)))
    return [(family, pool[k]) for k in keys], links


def cooldown(candidates: DataFrame, history: DataFrame, now: Column, days: int = COOLDOWN_DAYS) -> DataFrame:
    """Flag candidates never tested or last tested at least ``days`` ago."""
    last = history.groupBy("candidate_id").agg(F.max("tested_at").alias("last_tested_at"))
    due = F.col("last_tested_at").isNull() | (now >= F.col("last_tested_at") + F.expr(f"interval {days} days"))
    return candidates.join(last, "candidate_id", "left").withColumn("due", due)


def test_history(history: DataFrame, candidate: str) -> DataFrame:
    return history.filter(F.col("candidate_id") == candidate).orderBy(F.col("tested_at").desc())


def promote(survivors: DataFrame, deployed: DataFrame) -> DataFrame:
    """Survivors that are not deployed yet."""
    return survivors.join(deployed.select("candidate_id"), "candidate_id", "left_anti")


def deployed_candidates(deployed: DataFrame, survivors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parameters of deployed candidates; those that never survived are marked."""
    ok = survivors.select("candidate_id", F.lit(True).alias("survived"))
    return (
        deployed.select("candidate_id").join(candidates, "candidate_id").join(ok, "candidate_id", "left")
        .withColumn("survived", F.coalesce("survived", F.lit(False)))
    )
