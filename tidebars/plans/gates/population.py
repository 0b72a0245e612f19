"""All four gates over the whole routed population.

Signals. Spark computes indicators, once per window; exponential means of all spans advance together as lanes of one Arrow
kernel per block. Parameter sets that differ in thresholds only share indicators, and the rules that columns obey elsewhere are applied to the Arrow batches of these indicators, one character per bar and
parameter set. Plans are prepared side by side, as planning takes longer than running them.

Gates. The stored signals are folded once into summaries of pieces (``tidebars.operators.ranges``), and every window that
a gate asks for is a sum of pieces: both samples, the stress windows, the whole sample and each fold. Neighbours, fold
selection and verdicts are joins on the numbers of parameter sets. Circular shifts come from one Fourier transform per
batch of candidates, bootstraps from lists of trades that are redrawn where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebars.operators import backtest as bt, ranges
from tidebars.operators.candidates import tradable, variant_plan
from tidebars.operators.panel import make_panel
from tidebars.operators.sar import sar_codes
from tidebars.plans import report
from tidebars.plans.families import REGISTRY, Family, Held, Params, reading
from tidebars.plans.gates import oos, resample, stress, walkforward
from tidebars.session import materialize, shared_folder

#: Parameter sets with indicators of their own per plan (and where only spans of recursions tell them apart), plans prepared at the same time.
GROUPS_PER_PLAN, SPANS_PER_PLAN, PLANS_AT_ONCE = 27, 108, 8
#: Candidates per Fourier transform, redrawn sequences per task.
SHIFT_BATCH, DRAW_BATCH = 32, 250

# ---------------------------------------------------------------- parameter sets


@dataclass(frozen=True)
class Variants:
    """Numbered parameter sets: those of the grids and all their neighbours, and which is a variant of which."""

    wanted: list[tuple[str, Params]]
    links: list[tuple[int, int, int]]  # parent, variant, place among the family's sets by value
    parents: set[int]

    def table(self, spark: SparkSession) -> DataFrame:
        """``cand``, ``family``, ``params_key``, ``is_parent`` of every parameter set: a table of configuration size."""
        rows = [(i, f, REGISTRY[f].candidate_key(p), i in self.parents) for i, (f, p) in enumerate(self.wanted)]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["cand", "family", "params_key", "is_parent"]).astype({"cand": "int32"}))

    def link_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.links, columns=["parent", "cand", "param_order"], dtype="int32"))


def variants(families: list[str] | None = None) -> Variants:
    wanted, links, parents = [], [], set()
    for family in families or REGISTRY:
        grid = REGISTRY[family].combinations()
        plan, own = variant_plan(family, grid, include_self=True)
        base = len(wanted)
        links += [(base + a, base + b, order) for a, b, order in own]
        parents |= {base + a for a, _, _ in own}
        wanted += plan
    return Variants(wanted, links, parents)


class _Reads(dict):
    """A parameter set that remembers which of its values were asked for."""

    def __init__(self, params: Params):
        super().__init__(params)
        self.names: set[str] = set()

    def __getitem__(self, name: str) -> float:
        self.names.add(name)
        return super().__getitem__(name)


def thresholds(spec: Family, bars: DataFrame, params: Params) -> list[str]:
    """Parameters that only a rule reads, and that may be columns in it: they need no indicator of their own."""
    reads = _Reads(params)
    spec.prepare(make_panel(bars, ("symbol",), 1), reads)

    def may_be_column(name: str) -> bool:
        try:
            spec.rule({**params, name: F.lit(1.0)})
        except TypeError:  # it names an indicator
            return False
        return True

    return [n for n in spec.grid if n not in reads.names and may_be_column(n)]


@dataclass(frozen=True)
class Group:
    """Parameter sets that differ in thresholds only."""

    family: str
    fixed: Params
    numbers: tuple[int, ...]
    sets: tuple[Params, ...]

    def reads(self) -> set[str]:
        """Names of the columns its rule reads."""
        if self.family == "trend_psar":
            return {"sar_codes"}
        names: set[str] = set()
        with reading(lambda name: names.add(name) or F.lit(0.0)):
            REGISTRY[self.family].rule(self.sets[0])
        return names

    def signals(self, column: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Signal characters (as bytes) of every bar, one array per parameter set."""
        if self.family == "trend_psar":
            flat = "1" * len(self.sets)
            yield from np.frombuffer("".join(x or flat for x in column["sar_codes"]).encode(), np.uint8).reshape(-1, len(self.sets)).T
            return
        with reading(lambda name: column[name].view(Values)):
            for params in self.sets:
                rule = REGISTRY[self.family].rule(params)
                if isinstance(rule, Held):
                    flat_to = np.where(rule.enter_long, 2, np.where(rule.enter_short, 0, 1))
                    code = 6 * np.asarray(rule.exit_short) + 3 * np.asarray(rule.exit_long) + flat_to
                    yield np.where(rule.available, ord("a") + code, ord("k")).astype(np.uint8)
                else:
                    yield np.where(rule.long, ord("2"), np.where(rule.short, ord("0"), ord("1"))).astype(np.uint8)


class Values(np.ndarray):
    """A batch of a column, missing values as NaN: comparisons with them are not met, as in a filter."""

    def isNotNull(self) -> np.ndarray:  # noqa: N802 - the name rules know
        return ~np.isnan(self)


def plan_groups(bars: dict[str, DataFrame], all_sets: Variants) -> list[list[Group]]:
    """Groups of parameter sets by plan: those that are told apart by the same windows or spans are planned together,
    so that families share indicators. ``bars``: by universe."""
    alike: dict[tuple, dict[tuple, list[Group]]] = {}
    for family in dict.fromkeys(f for f, _ in all_sets.wanted):
        spec = REGISTRY[family]
        if spec.universe not in bars:
            continue
        own = [(i, p) for i, (f, p) in enumerate(all_sets.wanted) if f == family]
        free = tuple(spec.grid) if family == "trend_psar" else tuple(thresholds(spec, bars[spec.universe], own[0][1]))
        fixed = tuple(n for n in spec.grid if n not in free)
        found: dict[tuple, list[tuple[int, Params]]] = {}
        for i, p in own:
            found.setdefault(tuple(p[n] for n in fixed), []).append((i, p))
        bucket = alike.setdefault((spec.universe, fixed, family if family == "trend_psar" else ""), {})
        for value, members in found.items():
            bucket.setdefault(value, []).append(Group(family, members[0][1], tuple(i for i, _ in members), tuple(p for _, p in members)))
    plans = []
    for (_, fixed, _), bucket in alike.items():
        current: list[Group] = []
        most = SPANS_PER_PLAN if fixed and all(n.endswith("span") for n in fixed) else GROUPS_PER_PLAN
        for value in sorted(bucket):
            if current and len(current) + len(bucket[value]) > most:
                plans.append(current)
                current = []
            current = current + bucket[value]
        plans.append(current)
    return plans


# ---------------------------------------------------------------- signals and summaries


def interpreted(spark: SparkSession) -> SparkSession:
    """A session of its own for plans of hundreds of windows: code generated for them is compiled once, used on few rows a
    task, and fills the code cache of the JVM, so it is not generated."""
    quiet = spark.newSession()
    quiet.conf.set("spark.sql.codegen.wholeStage", "false")
    quiet.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return quiet


def with_folds(quiet: SparkSession, bars: DataFrame, folds: walkforward.Plan) -> DataFrame:
    """The whole series (part ``full``, fold 0) and every training and test fold as series of their own, stored, in session ``quiet``."""
    whole = bars.withColumns({"part": F.lit("full"), "fold": F.lit(0)})
    sliced = walkforward.slices(bars, folds)
    every, path = whole.unionByName(sliced.select(*whole.columns)), shared_folder(bars.sparkSession, "series")
    every.write.parquet(path)
    return quiet.read.schema(every.schema).parquet(path)


SIGNALS = (
    "chunk int, symbol string, part string, fold int, blk int, bar_no int, open double, next_open double, fill_spread_fraction double, t long, maps binary"
)


def signal_maps(series: DataFrame, groups: list[Group], chunk: int) -> str:
    """Folder of the stored signals of one plan (``SIGNALS``): series keys, bars and ``maps``, one character per parameter set.

    Spark computes the indicators; rules compare them with thresholds, batch by batch, where the indicators are.
    """
    keys = walkforward.FOLD
    sets = [(g.family, p) for g in groups for p in g.sets]
    if groups[0].family == "trend_psar":
        series = sar_codes(series, keys, [p for _, p in sets])
    panel = make_panel(series, keys, max(int(REGISTRY[f].lookback(p)) for f, p in sets) + 2, in_lanes=True)
    for g in groups:
        panel = REGISTRY[g.family].prepare(panel, g.fixed)
    names = sorted(set().union(*[g.reads() for g in groups]))
    bars = ["bar_no", "open", "next_open", "fill_spread_fraction", "t"]
    settled = panel.settle()
    # A missing truth value is not met.
    value = {n: F.coalesce(F.col(n), F.lit(False)) if kind == "boolean" else F.col(n) for n, kind in settled.dtypes}
    rows = settled.select(
        F.lit(chunk).alias("chunk"), F.coalesce("symbol", F.lit("")).alias("symbol"), "part", F.col("fold").cast("int").alias("fold"),
        (F.col("bar_no") / ranges.BLOCK_ROWS).cast("int").alias("blk"), F.col("bar_no").cast("int").alias("bar_no"), "open", "next_open",
        "fill_spread_fraction", F.unix_timestamp("ts").alias("t"), *[value[n].alias(f"x{k}") for k, n in enumerate(names)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(f"x{k}").to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
            column = {n: v if v.dtype in (object, bool) else v.astype(np.float64) for n, v in column.items()}
            maps = np.stack([x for g in groups for x in g.signals(column)], axis=1)
            ends = np.arange(len(maps) + 1, dtype=np.int32) * maps.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(maps), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(maps))])
            keep = [batch.column(n) for n in ("chunk", "symbol", "part", "fold", "blk", *bars)]
            yield pa.record_batch([*keep, packed], ["chunk", "symbol", "part", "fold", "blk", *bars, "maps"])

    path = shared_folder(series.sparkSession, "maps")
    rows.mapInArrow(run, SIGNALS).write.parquet(path)
    return path


def wanted_windows(full: DataFrame, split: oos.Split, s: stress.Stress) -> DataFrame:
    """``symbol``, ``part``, ``win``, ``in_pieces``, ``cuts`` of whole series: samples, stress windows and everything. Ends are inclusive."""
    at = lambda text: F.unix_timestamp(F.lit(text).cast("timestamp"))
    symbols = full.select("symbol").distinct()
    fixed = [("is", at(split.in_sample_start), at(split.in_sample_end) + 1), ("oos", at(split.out_of_sample_start), F.lit(None).cast("long")), ("all", F.lit(None).cast("long"), F.lit(None).cast("long"))]
    rows = [symbols.select("symbol", F.lit(n).alias("win"), a.alias("a"), b.alias("b")) for n, a, b in fixed]
    stressed = stress.stress_windows(full, s).select("symbol", F.col("stress_id").alias("win"), F.unix_timestamp("stress_start").alias("a"), (F.unix_timestamp("stress_end") + 1).alias("b"))
    every = materialize(reduce(DataFrame.unionByName, [*rows, stressed]), "windows")
    cuts = every.groupBy("symbol").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("a", "b")))))).alias("cuts"))
    # Piece k lies between cuts k and k + 1 (from 1); piece 0 is before the first cut.
    joined = every.join(cuts, "symbol")
    first = F.when(F.col("a").isNull(), 0).otherwise(F.array_position("cuts", F.col("a"))).cast("int")
    last = F.when(F.col("b").isNull(), F.size("cuts")).otherwise(F.array_position("cuts", F.col("b")) - 1).cast("int")
    return joined.select("symbol", F.lit("full").alias("part"), "win", F.sequence(first, last).alias("in_pieces"), "cuts")


def fold_windows(symbols: DataFrame) -> DataFrame:
    parts = F.explode(F.array(F.lit("train"), F.lit("test"))).alias("part")
    return symbols.select("symbol", parts).select("symbol", "part", F.lit("fold").alias("win"), F.array(F.lit(0)).alias("in_pieces"))


def performance(rows: DataFrame, kind: str = "") -> DataFrame:
    """Names of ``tidebars.operators.backtest.metrics`` for the net series of window results (``kind`` s_: under stress, growth and drawdown only)."""
    n = F.col("n").cast("double")
    ends = F.timestamp_seconds("t0"), F.timestamp_seconds("t1")
    rows = rows.withColumns({"growth_net": F.col(f"{kind}growth"), "dip_net": F.col(f"{kind}dip"), "sum_net": F.col("sum"), "sq_net": F.col("sq"), "ppy": bt.periods_per_year(F.col("n"), *ends)})
    perf = bt._performance("net", n, F.col("ppy"), "net")
    share = F.when(F.col("trades") > 0, F.coalesce(sum(F.col(f"top{i}") for i in range(ranges.TOP)) / F.nullif(F.col("profit"), F.lit(0.0)), F.lit(1.0)))
    return rows.withColumns(
        {
            **perf,
            "observation_count": F.col("n"),
            "trade_count": F.col("trades").cast("long"),
            "total_transaction_cost": F.col("cost"),
            "terminal_nav": F.col(f"{kind}growth"),
            "worst_bar_return": F.col(f"{kind}worst"),
            "top_5_trade_profit_share": share,
        }
    )


# ---------------------------------------------------------------- resampling


def _positions(signals: DataFrame, start: DataFrame, slots: dict[int, list[int]], commission: float) -> DataFrame:
    """Executed positions of grid candidates in whole series, ``SHIFT_BATCH`` candidates per row and block."""
    schema = pa.schema([("chunk", pa.int32()), ("symbol", pa.string()), ("batch", pa.int32()), ("blk", pa.int32()), ("t0", pa.int64()), ("t1", pa.int64()), ("market", pa.binary()), ("side_cost", pa.binary()), ("executed", pa.binary())])

    def run(key: tuple, table: pa.Table, begin: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        own = slots[key[0].as_py()]
        state, prior = (np.frombuffer(begin[c][0].as_py(), np.uint8)[own] for c in ("state", "prior"))
        executed = ranges.held(ranges._maps(table)[:, own], state, prior)[1:-1]
        valid = np.asarray(table["next_open"].is_valid())
        table, executed = table.filter(pa.array(valid)), executed[valid]
        rows = {n: [] for n in schema.names}
        if table.num_rows:
            none = np.zeros((table.num_rows, 1), np.int8)
            _, spread, rate, market = ranges.costed(table, none + 1, none, commission)
            t = table["t"].to_numpy()
            for batch in range(0, len(own), SHIFT_BATCH):
                part = np.ascontiguousarray(executed[:, batch : batch + SHIFT_BATCH])
                for n, v in zip(schema.names, (key[0].as_py(), key[1].as_py(), batch // SHIFT_BATCH, key[4].as_py(), int(t[0]), int(t[-1]), market.tobytes(), (spread + rate)[:, 0].tobytes(), part.tobytes())):
                    rows[n].append(v)
        return pa.Table.from_pydict(rows, schema=schema)

    keys = (*ranges.SERIES, "blk")
    full = signals.where(F.col("part") == "full").drop("cuts")
    known = start.where((F.col("part") == "full") & F.col("chunk").isin(list(slots)))
    both = full.where(F.col("chunk").isin(list(slots))).groupBy(*keys).cogroup(known.groupBy(*keys))
    return both.applyInArrow(run, "chunk int, symbol string, batch int, blk int, t0 long, t1 long, market binary, side_cost binary, executed binary")


def null_sharpes(executed: np.ndarray, market: np.ndarray, cost: np.ndarray, ppy: float) -> tuple[np.ndarray, np.ndarray]:
    """Observed Sharpe per candidate, and the Sharpe of every circular shift of the market (shift x candidate).

    The sum of position times shifted return is a circular cross-correlation, as are the two parts of the sum of squares
    that depend on the shift; costs stay where the positions are.
    """
    n = len(market)
    spectrum = lambda x: np.fft.rfft(x, axis=0)
    r, r2 = np.conj(spectrum(market[:, None])), np.conj(spectrum((market * market)[:, None]))
    e = executed.astype(np.float64)
    at_shift = lambda a, b: np.fft.irfft(spectrum(a) * b, n, axis=0)
    total = at_shift(e, r) - cost.sum(axis=0)
    square = at_shift(e * e, r2) - 2 * at_shift(cost * e, r) + (cost * cost).sum(axis=0)
    var = (square - total * total / n) / (n - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        null = np.where(var > 1e-24, total / n / np.sqrt(np.maximum(var, 0)) * np.sqrt(ppy), np.nan)
        net = e * market[:, None] - cost
        sd = net.std(axis=0, ddof=1)
        observed = np.where(sd > 1e-15, net.mean(axis=0) / sd * np.sqrt(ppy), np.nan)
    return observed, null


_RESAMPLED = "chunk int, symbol string, slot int, observed_net_sharpe double, permutation_count long, permutation_mean_sharpe double, permutation_median_sharpe double, permutation_sharpe_p95 double, permutation_p_value double, trades binary"


def permutations(blocks: DataFrame, labels: DataFrame, slots: dict[int, list[int]], count: int) -> DataFrame:
    """Permutation results and the list of net trade returns of every grid candidate. ``labels``: chunk, symbol, batch, slot, label, n."""
    shift = lambda j: (1 + resample.draw(F.col("label"), F.lit("shift"), j.cast("string")) % (F.col("n") - 1)).cast("int")
    drawn = labels.where("n >= 3").select("chunk", "symbol", "batch", "slot", F.transform(F.sequence(F.lit(1), F.lit(count)), shift).alias("shifts"))
    schema = pa.schema([("chunk", pa.int32()), ("symbol", pa.string()), ("slot", pa.int32()), ("observed_net_sharpe", pa.float64()), ("permutation_count", pa.int64()), *[(c, pa.float64()) for c in ("permutation_mean_sharpe", "permutation_median_sharpe", "permutation_sharpe_p95", "permutation_p_value")], ("trades", pa.binary())])

    def run(key: tuple, table: pa.Table, shifts: pa.Table) -> pa.Table:
        rows = table.sort_by("blk").to_pylist()
        out = []
        if rows and shifts.num_rows:
            market, rate = (np.concatenate([np.frombuffer(r[c]) for r in rows]) for c in ("market", "side_cost"))
            own = slots[key[0].as_py()][key[2].as_py() * SHIFT_BATCH :][:SHIFT_BATCH]
            executed = np.concatenate([np.frombuffer(r["executed"], np.int8).reshape(-1, len(own)) for r in rows])
            cost = np.abs(np.diff(executed, axis=0, prepend=np.zeros((1, len(own)), np.int8))) * rate[:, None]
            span, n = rows[-1]["t1"] - rows[0]["t0"], len(market)
            ppy = n / (span / bt.SECONDS_PER_YEAR) if span > 0 else np.nan
            observed, null = null_sharpes(executed, market, cost, ppy)
            by_slot = {s["slot"]: np.array(s["shifts"]) for s in shifts.to_pylist()}
            for k, slot in enumerate(own):
                x = null[by_slot[slot], k]
                x = x[~np.isnan(x)]
                growth = _trades(executed[:, k], executed[:, k] * market - cost[:, k])
                reached = int((x >= observed[k] - 1e-9).sum()) if len(x) else 0
                stats = (float(x.mean()), float(np.percentile(x, 50)), float(np.percentile(x, 95)), (1 + reached) / (len(x) + 1)) if len(x) else (None,) * 4
                out.append((key[0].as_py(), key[1].as_py(), slot, None if np.isnan(observed[k]) else float(observed[k]), len(x), *stats, growth.tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    keys = ("chunk", "symbol", "batch")
    return blocks.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInArrow(run, _RESAMPLED)


def _trades(position: np.ndarray, net: np.ndarray) -> np.ndarray:
    begin = np.flatnonzero(np.diff(position, prepend=np.int8(-2)))
    growth = np.multiply.reduceat(1 + net, begin)
    return growth[position[begin] != 0] - 1


def bootstrap(lists: DataFrame, count: int) -> DataFrame:
    """Statistics of redrawn trade sequences. ``lists``: symbol, cand, label, ``trades`` (doubles). Draws depend on the label and the piece only."""
    pieces = lists.select("symbol", "cand", "label", "trades", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // DRAW_BATCH))).alias("piece"))

    def redraw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                trades = np.frombuffer(r["trades"])
                reps = min(DRAW_BATCH, count - r["piece"] * DRAW_BATCH)
                seed = int.from_bytes(hashlib.sha256(f"{r['label']}#boot#{r['piece']}".encode()).digest()[:16], "big")
                grown = np.log1p(np.maximum(trades, -1 + 1e-15))[np.random.Generator(np.random.Philox(seed)).integers(0, len(trades), (reps, len(trades)))]
                nav = np.cumsum(grown, axis=1)
                down = np.minimum((nav - np.maximum(np.maximum.accumulate(nav, axis=1), 0.0)).min(axis=1), 0.0)
                out.append((r["symbol"], r["cand"], len(trades), np.expm1(nav[:, -1]).tobytes(), np.abs(np.expm1(down)).tobytes()))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["symbol", "cand", "n", "total", "drawdown"])

    schema = pa.schema([("symbol", pa.string()), ("cand", pa.int32()), ("bootstrap_count", pa.int64()), ("bootstrap_trade_count", pa.int64()), *[(c, pa.float64()) for c in ("bootstrap_median_total_return", "bootstrap_total_return_p05", "bootstrap_total_return_p95", "bootstrap_probability_negative_return", "bootstrap_median_max_drawdown", "bootstrap_drawdown_p95")]])

    def statistics(key: tuple, table: pa.Table) -> pa.Table:
        total, drawdown = (np.concatenate([np.frombuffer(x) for x in table[c].to_pylist()]) for c in ("total", "drawdown"))
        values = (key[0].as_py(), key[1].as_py(), len(total), table["n"][0].as_py(), *np.percentile(total, [50, 5, 95]), (total < 0).mean(), *np.percentile(drawdown, [50, 95]))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    spread = pieces.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "cand", "piece")
    redrawn = spread.mapInArrow(redraw, "symbol string, cand int, n long, total binary, drawdown binary")
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
    return redrawn.groupBy("symbol", "cand").applyInArrow(statistics, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


def moments(whole: DataFrame) -> DataFrame:
    """As ``resample.moments``, from power sums."""
    n, c = F.col("n").cast("double"), F.col
    m1, m2, m3, m4 = (c(x) / n for x in ("sum", "sq", "cube", "fourth"))
    v2 = F.greatest(m2 - m1 * m1, F.lit(0.0))
    v3 = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    v4 = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    df = whole.withColumns({"_sd": F.sqrt(v2 * n / F.nullif(n - 1, F.lit(0.0))), "_g1": v3 / F.nullif(F.pow(v2, F.lit(1.5)), F.lit(0.0)), "_g2": v4 / F.nullif(v2 * v2, F.lit(0.0)) - 3})
    usable = (n >= 3) & (c("_sd") > 1e-15)
    return df.select(
        "symbol", "cand",
        c("n").cast("long").alias("dsr_observation_count"),
        F.when(usable, m1 / c("_sd")).alias("dsr_period_sharpe"),
        F.when(usable, c("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("dsr_skewness"),
        F.when(usable, (n - 1) / ((n - 2) * F.nullif(n - 3, F.lit(0.0))) * ((n + 1) * c("_g2") + 6) + 3).alias("dsr_kurtosis"),
    )


# ---------------------------------------------------------------- gates


def gate1(results: DataFrame, links: DataFrame, listed: DataFrame, c: oos.Criteria) -> DataFrame:
    """Verdicts with out-of-sample and in-sample figures of every listed (symbol, cand)."""
    out = materialize(performance(results.where("win = 'oos'")), "oos")
    near = oos.sensitivity(out, links.where("parent <> cand"), c)
    own = oos.performance(out, c)
    figures = ("net_sharpe", "net_total_return", "net_max_drawdown", "trade_count")
    inside = performance(results.where("win = 'is'")).select("symbol", "cand", *[F.col(f).alias(f"in_sample_{f}") for f in figures])
    keep = own.select("symbol", "cand", *figures, "top_5_trade_profit_share", "performance_failures")
    joined = listed.join(keep, ["symbol", "cand"], "left").join(near.withColumnRenamed("parent", "cand"), ["symbol", "cand"], "left").join(inside, ["symbol", "cand"], "left")
    none, unseen = F.array(F.lit("no_valid_neighbors")), F.array(F.lit("no_oos_observations"))
    reasons = F.coalesce(F.concat("performance_failures", F.coalesce("sensitivity_failures", none)), unseen)
    return joined.withColumns({"layer1_pass": F.size(reasons) == 0, "failure_reason": F.array_join(reasons, ";")}).drop("performance_failures", "sensitivity_failures")


def gate2(results: DataFrame, links: DataFrame, names: DataFrame, listed: DataFrame, p: walkforward.Plan) -> DataFrame:
    folds = results.where("win = 'fold'")
    train = performance(folds.where("part = 'train'"))
    chosen = walkforward.select(train, links, p)
    test = performance(folds.where("part = 'test'")).select(
        "symbol", "fold", "cand", "n", "t0", "t1", "sum", "sq", "cost", "growth", "high", "low", "dip",
        F.col("net_total_return").alias("test_net_return"), F.col("net_sharpe").alias("test_net_sharpe"),
        F.col("net_max_drawdown").alias("test_max_drawdown"), F.col("trade_count").alias("test_trade_count"),
    )
    picked = materialize(chosen.join(test, ["symbol", "fold", "cand"]).join(names.select("cand", F.col("params_key").alias("chosen")), "cand"), "results")
    agg = walkforward.stability(picked).join(concatenated(picked), ["symbol", "parent"])
    listed = listed.withColumnRenamed("cand", "parent")
    return walkforward.judge(listed.join(agg, ["symbol", "parent"], "left"), p).withColumnRenamed("parent", "cand")


def concatenated(picked: DataFrame) -> DataFrame:
    """Net figures of the chosen test folds of a parent, one after the other: one row per fold is folded in order."""
    order = Window.partitionBy("symbol", "parent").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.product("growth").over(order), F.lit(1.0))
    df = picked.withColumn("base", base).withColumn("peak", F.max(F.col("base") * F.col("high")).over(order))
    low = F.col("base") * F.col("low")
    dip = F.when(low <= 0, 0.0).otherwise(F.least(F.col("dip"), low / F.col("peak")))
    sums = df.groupBy("symbol", "parent").agg(
        F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("sum").alias("sum"), F.sum("sq").alias("sq"),
        F.sum("cost").alias("cost"), F.product("growth").alias("growth"), F.min(dip).alias("dip"),
    )
    none = {"worst": F.lit(None).cast("double"), "trades": F.lit(None).cast("double"), "profit": F.lit(None).cast("double"), **{f"top{i}": F.lit(None).cast("double") for i in range(ranges.TOP)}}
    return performance(sums.withColumns(none)).select(
        "symbol", "parent", F.col("net_sharpe").alias("walkforward_net_sharpe"), F.col("net_total_return").alias("walkforward_net_total_return"),
        F.col("net_max_drawdown").alias("walkforward_net_max_drawdown"), F.col("total_transaction_cost").alias("walkforward_total_transaction_cost"),
        F.col("observation_count").alias("walkforward_observation_count"),
    )


def gate3(results: DataFrame, full: DataFrame, listed: DataFrame, s: stress.Stress) -> DataFrame:
    stressed = results.join(listed, ["symbol", "cand"], "left_semi")
    kind = F.when(F.col("win") == "fixed", "fixed_historical").otherwise("worst_market_window")
    hist = stressed.where(~F.col("win").isin("is", "oos", "all", "fold")).withColumns({"stress_id": F.col("win"), "stress_type": kind})
    whole = performance(stressed.where("win = 'all'"), "s_")
    return stress.judge(stress._short(performance(hist)), stress._short(whole), full, s)


@dataclass(frozen=True)
class Population:
    """Stored inputs of all gates: window results of every parameter set, and signals to resample from."""

    sets: Variants
    listed: DataFrame
    names: DataFrame
    links: DataFrame
    results: DataFrame
    resampled: DataFrame
    full: DataFrame


def prepare(
    single: DataFrame | None, pairs: DataFrame | None, universe: DataFrame, split: oos.Split, folds: walkforward.Plan, s: stress.Stress,
    r: resample.Resampling, families: list[str] | None = None,
) -> Population:
    """Signals of all parameter sets, summaries, and windows, on numbered, stored bars. ``universe``: symbol, kind, sec_type, what_to_show."""
    spark = universe.sparkSession
    sets, quiet = variants(families), interpreted(spark)
    whole, bars = {}, {}
    for kind in dict.fromkeys(REGISTRY[f].universe for f, _ in sets.wanted):
        source = pairs if kind == "pairs" else single
        if source is not None:
            whole[kind] = materialize(source.join(universe.where(tradable(F.lit(kind))).select("symbol"), "symbol", "left_semi"), "routed")
            bars[kind] = with_folds(quiet, whole[kind], folds)
    plans = plan_groups(bars, sets)
    with ThreadPoolExecutor(PLANS_AT_ONCE) as pool:
        stored = list(pool.map(lambda job: signal_maps(bars[REGISTRY[job[1][0].family].universe], job[1], job[0]), enumerate(plans)))
    signals = spark.read.schema(SIGNALS).parquet(*stored)
    numbers = [[i for g in groups for i in g.numbers] for groups in plans]
    slot_rows = [(k, slot, cand) for k, own in enumerate(numbers) for slot, cand in enumerate(own)]
    slot_table = spark.createDataFrame(pd.DataFrame(slot_rows, columns=["chunk", "slot", "cand"], dtype="int32"))
    names, links = materialize(sets.table(spark), "names"), materialize(sets.link_table(spark), "links")

    columns = ["symbol", "ts", "open"]
    full = materialize(reduce(DataFrame.unionByName, [b.select(*columns) for k, b in whole.items() if k not in ("cash", "real_volume")] or [b.select(*columns) for b in whole.values()]).distinct(), "full")
    wins = materialize(wanted_windows(full, split, s), "cuts")
    cuts = wins.select("symbol", "part", "cuts").distinct()
    start = materialize(ranges.starts(signals), "starts")
    nodes = materialize(ranges.pieces(signals.join(cuts, ["symbol", "part"], "left"), start), "pieces")
    every = wins.drop("cuts").unionByName(fold_windows(full.select("symbol").distinct()))
    found = ranges.windows(ranges.second_level(nodes), every).join(slot_table, ["chunk", "slot"])
    results = materialize(found, "window-results")

    slots = {k: [slot for slot, cand in enumerate(own) if cand in sets.parents] for k, own in enumerate(numbers)}
    slots = {k: own for k, own in slots.items() if own}
    blocks = materialize(_positions(signals, start, slots, bt.COMMISSION_BPS / 1e4), "blocks")
    batch_rows = [(k, slot, place // SHIFT_BATCH) for k, own in slots.items() for place, slot in enumerate(own)]
    batches = spark.createDataFrame(pd.DataFrame(batch_rows, columns=["chunk", "slot", "batch"], dtype="int32"))
    own = results.where("win = 'all'").select("chunk", "symbol", "slot", "cand", "n").join(batches, ["chunk", "slot"]).join(names, "cand")
    labels = own.withColumn("label", resample.label())
    resampled = permutations(blocks, labels, slots, r.permutations).join(labels.select("chunk", "symbol", "slot", "cand", "label"), ["chunk", "symbol", "slot"])
    listed = results.where("win = 'all'").join(names.where("is_parent"), "cand", "left_semi").select("symbol", "cand")
    return Population(sets, materialize(listed, "listed"), names, links, results, materialize(resampled, "resampled"), full)


def gate4(p: Population, trials: DataFrame, r: resample.Resampling) -> DataFrame:
    keys = ("symbol", "cand")
    lists = p.resampled.where(F.octet_length("trades") > 0).select("symbol", "cand", "label", "trades")
    # A trade of -100 % or less cannot be compounded: such a candidate has no bootstrap.
    whole = p.results.where("win = 'all'").join(p.listed, [*keys], "left_semi")
    boot = bootstrap(compoundable(lists), r.bootstraps)
    return resample.judge(p.resampled.drop("chunk", "slot", "label", "trades"), boot, resample.deflated_sharpe(moments(whole), trials), keys, r)


def compoundable(lists: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(np.frombuffer(x).min() > -1) for x in batch.column("trades").to_pylist()], pa.bool_()))

    return lists.mapInArrow(run, lists.schema)


def gate_tables(
    single: DataFrame | None, pairs: DataFrame | None, universe: DataFrame, trials: DataFrame, split: oos.Split,
    folds: walkforward.Plan = walkforward.Plan(), s: stress.Stress = stress.Stress(), r: resample.Resampling = resample.Resampling(),
    families: list[str] | None = None, c: oos.Criteria = oos.Criteria(),
) -> list[DataFrame]:
    """One stored table per gate over all families, with ``family``, ``symbol``, ``params_key``, ``candidate_id``."""
    p = prepare(single, pairs, universe, split, folds, s, r, families)
    verdicts = [gate1(p.results, p.links, p.listed, c), gate2(p.results, p.links, p.names, p.listed, folds), gate3(p.results, p.full, p.listed, s), gate4(p, trials, r)]
    named = [v.join(p.names.drop("is_parent"), "cand").drop("cand").withColumn("candidate_id", F.concat_ws("__", "family", "symbol", "params_key")) for v in verdicts]
    with ThreadPoolExecutor(len(named)) as pool:
        return list(pool.map(lambda v: materialize(v[1], f"layer{v[0]}"), enumerate(named, 1)))


def funnel(candidates: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Every candidate with its four decisions and reasons; where a gate has no row, the decision is a fail with that reason."""
    l1, *rest = tables
    start = candidates.select("candidate_id", "family", "symbol").join(l1.select("candidate_id", "layer1_pass"), "candidate_id", "left")
    out = report.final_funnel(start, *[t.select("candidate_id", f"layer{i}_pass") for i, t in enumerate(rest, 2)])
    for i, t in enumerate(tables, 1):
        name = f"layer{i}_failure"
        out = out.join(t.select("candidate_id", F.col("failure_reason").alias(name)), "candidate_id", "left").withColumn(name, F.coalesce(name, F.lit("no_gate_row")))
    return out
