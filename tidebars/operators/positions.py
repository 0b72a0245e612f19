"""From rule conditions to positions, for many candidates of a symbol at once.

All parameter sets of a run travel as one short string per bar (one character each), so
bars are shuffled once, however many candidates there are; rows multiply only at the
very end, inside the task that already holds the block.

Held rules are a three-state machine. One bar is a map of {-1, 0, 1} onto itself, maps
compose associatively, and so a block can be folded on its own: each block yields the
composed map after every bar. The small table of block-end maps is then folded to the
state every block starts in, and that state selects the real positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebars.operators.panel import make_panel
from tidebars.operators.sar import sar_codes
from tidebars.plans.families import REGISTRY, Held, Level, Params
from tidebars.session import fan_out, materialize

SCAN_ROWS = 512
BAR_COLUMNS = ("bar_no", "ts", "prev_ts", "open", "next_open", "fill_spread_fraction")

# A composed map is coded base 3 by the images of -1, 0, 1 (digits 0, 1, 2 = -1, 0, 1).
IDENTITY = 5


def _images(code: int) -> tuple[int, int, int]:
    return code // 9, code // 3 % 3, code % 3


def _bar_images(code: int) -> tuple[int, int, int]:
    """Images of a bar map: does short leave, where flat goes, does long leave."""
    leave_short, leave_long, flat_to = code // 6, code // 3 % 2, code % 3
    return (1 if leave_short else 0), flat_to, (1 if leave_long else 2)


def _composition_table() -> str:
    """Entry 12*c + m: the map c followed by bar map m, as a character from 'A' on."""
    out = []
    for code in range(27):
        for bar in range(12):
            step = _bar_images(bar)
            a, b, d = (step[i] for i in _images(code))
            out.append(chr(65 + 9 * a + 3 * b + d))
    return "".join(out)


def _state_tables() -> list[str]:
    """For each start state, the state digit every composed map leads to."""
    return ["".join(str(_images(code)[s]) for code in range(27)) for s in range(3)]


MAP_ALPHABET = "".join(chr(65 + i) for i in range(27))


def level_code(rule: Level) -> Column:
    return F.when(rule.long, "2").when(rule.short, "0").otherwise("1")


def held_code(rule: Held) -> Column:
    one = lambda cond, k: F.when(cond, k).otherwise(0)
    flat_to = F.when(rule.enter_long, 2).when(rule.enter_short, 0).otherwise(1)
    code = one(rule.exit_short, 6) + one(rule.exit_long, 3) + flat_to
    return F.when(rule.available, F.substring(F.lit("abcdefghijkl"), code + F.lit(1), F.lit(1))).otherwise("k")


def _fold_block(codes_field: str, count: int) -> Column:
    """Per parameter set: the composed maps after each bar of a block, as one string."""
    table = _composition_table()
    nxt = (
        f"substr('{table}', acc.c * 12 + ascii(substr(x.{codes_field}, pid, 1)) - 96, 1)"
    )
    return F.expr(
        f"transform(sequence(1, {count}), pid -> aggregate(bars, "
        f"named_struct('c', {IDENTITY}, 'o', ''), "
        f"(acc, x) -> named_struct('c', ascii({nxt}) - 65, 'o', concat(acc.o, {nxt})), acc -> acc.o))"
    )


def _digit(map_char: str, state: str) -> str:
    """SQL: where the map leads from a state digit."""
    return f"substr('{''.join(''.join(str(d) for d in _images(c)) for c in range(27))}', (ascii({map_char}) - 65) * 3 + cast({state} as int) + 1, 1)"


def held_positions(rows: DataFrame, keys: tuple[str, ...], codes: str, count: int, carry: tuple[str, ...]) -> DataFrame:
    """Target, executed and previous executed state digit of every bar and parameter set."""
    # Join keys that cannot be null keep both uses of ``blocks`` identical, so that its
    # shuffle runs once; the outer generators spare a filter that would fold twice.
    blocks = (
        rows.withColumn("blk", F.coalesce((F.col("bar_no") / SCAN_ROWS).cast("int"), F.lit(0)))
        .repartition(fan_out(rows.sparkSession), *keys, "blk")
        .groupBy(*keys, "blk")
        .agg(F.sort_array(F.collect_list(F.struct("bar_no", codes, *[c for c in carry if c != "bar_no"]))).alias("bars"))
        .withColumn("maps", _fold_block(codes, count))
    )
    last = F.expr("array_join(transform(maps, m -> substr(m, -1, 1)), '')")
    before = F.expr(f"array_join(transform(maps, m -> if(length(m) > 1, substr(m, -2, 1), '{chr(65 + IDENTITY)}')), '')")
    ends = blocks.select(*keys, "blk", last.alias("ends"), before.alias("befores"))
    flat = "repeat('1', {n})".format(n=count)
    step = lambda maps: f"array_join(transform(sequence(1, {count}), i -> {_digit(f'substr(b.{maps}, i, 1)', 'substr(acc.s, i, 1)')}), '')"
    starts = (
        ends.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("blk", "ends", "befores"))).alias("bs"))
        .select(
            *keys,
            F.expr(
                f"inline_outer(aggregate(bs, named_struct('s', {flat}, 'p', {flat}, 'o', cast(array() as "
                "array<struct<blk:int,state:string,prior:string>>)), (acc, b) -> named_struct("
                f"'s', {step('ends')}, 'p', {step('befores')}, "
                "'o', concat(acc.o, array(named_struct('blk', b.blk, 'state', acc.s, 'prior', acc.p)))), acc -> acc.o))"
            ),
        )
    )
    tables = _state_tables()
    s = "substr(state, pid + 1, 1)"
    states = (
        f"translate(map, '{MAP_ALPHABET}', CASE {s} WHEN '0' THEN '{tables[0]}' "
        f"WHEN '1' THEN '{tables[1]}' ELSE '{tables[2]}' END)"
    )
    fields = ", ".join(f"'{c}', x.{c}" for c in carry)
    return (
        blocks.join(starts, [*keys, "blk"])
        .select(*keys, "blk", "bars", "state", "prior", F.posexplode_outer("maps").alias("pid", "map"))
        .select(*keys, "blk", "pid", "bars", F.expr(f"split(concat(substr(prior, pid + 1, 1), {s}, {states}), '')").alias("st"))
        .select(
            *keys,
            "blk",
            "pid",
            F.expr(
                f"inline_outer(transform(bars, (x, i) -> named_struct({fields}, "
                "'target', cast(st[i + 2] as int) - 1, 'executed', cast(st[i + 1] as int) - 1, "
                "'before', cast(st[i] as int) - 1)))"
            ),
        )
    )


def level_positions(rows: DataFrame, keys: tuple[str, ...], count: int, carry: tuple[str, ...]) -> DataFrame:
    """One row per parameter set from the digit strings of a bar and its two predecessors.

    Bars are placed by (key, block) before rows multiply, which later windows reuse.
    """
    digit = lambda name: F.expr(f"cast(substr({name}, pid + 1, 1) as int) - 1")
    return (
        rows.repartition(fan_out(rows.sparkSession), *keys, "blk")
        .select(*keys, "blk", *carry, "codes", "codes1", "codes2", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("pid"))
        .select(
            *keys, "blk", "pid", *carry,
            digit("codes").alias("target"), digit("codes1").alias("executed"), digit("codes2").alias("before"),
        )
    )


def positions(
    numbered: DataFrame,
    wanted: list[tuple[str, Params]],
    keys: tuple[str, ...] = ("symbol",),
    block_rows: int | None = None,
    carry: tuple[str, ...] = BAR_COLUMNS,
) -> DataFrame:
    """Positions of every wanted (family, parameters) on every series of numbered bars.

    Output: keys, ``blk``, ``cand`` (index into ``wanted``), the carried bar columns,
    ``target`` (this bar's signal), ``executed`` (held during this bar) and ``before``
    (held during the previous bar), all in {-1, 0, 1}. Names are added with ``named``
    once rows are few: sorting and shuffling by a number is cheaper.
    """
    types = dict(numbered.dtypes)
    sar = [(f, p) for f, p in wanted if f == "trend_psar"]
    if sar:
        numbered = sar_codes(numbered, keys, [p for _, p in sar])
    halo = max(int(REGISTRY[f].lookback(p)) for f, p in wanted) + 2
    panel = make_panel(numbered, keys, halo, block_rows)
    levels, helds = [], []
    for index, (family, params) in enumerate(wanted):
        spec = REGISTRY[family]
        panel = spec.prepare(panel, params)
        rule = spec.rule(params)
        if isinstance(rule, Held):
            helds.append((index, held_code(rule)))
        elif isinstance(rule, Level):
            levels.append((index, level_code(rule)))
    # Signals are stored as one short string per bar: later steps start from a small
    # table instead of repeating (and re-planning) every indicator.
    stored = {c: F.col(c) for c in (*keys, "blk", *carry)}
    indexes = [i for i, _ in levels] + [i for i, (f, _) in enumerate(wanted) if f == "trend_psar"]
    if indexes:
        pieces = [code for _, code in levels] + ([F.coalesce(F.col("sar_codes"), F.lit("1" * len(sar)))] if sar else [])
        panel = panel.add(codes=F.concat(*pieces))
        flat = F.lit("1" * len(indexes))
        lags = {f"codes{k}": F.coalesce(panel.lag("codes", k), flat) for k in (1, 2)}
        panel = panel.add(**lags)
        stored |= {c: F.col(c) for c in ("codes", *lags)}
    if helds:
        stored["held"] = F.concat(*[code for _, code in helds])
    rows = materialize(panel.settle().select(*[c.alias(n) for n, c in stored.items()]), "signals")
    # Reading back makes columns nullable; see held_positions for why keys must not be.
    rows = rows.withColumns({k: F.coalesce(F.col(k), F.lit("" if types[k] == "string" else 0)) for k in keys})
    parts = []
    if indexes:
        parts.append(_indexed(level_positions(rows, keys, len(indexes), carry), indexes))
    if helds:
        part = held_positions(rows, keys, "held", len(helds), carry)
        parts.append(_indexed(part, [i for i, _ in helds]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _indexed(df: DataFrame, indexes: list[int]) -> DataFrame:
    cand = F.col("pid") if indexes == list(range(len(indexes))) else F.element_at(F.array(*[F.lit(i) for i in indexes]), F.col("pid") + 1)
    return df.withColumn("cand", cand).drop("pid")


def named(df: DataFrame, wanted: list[tuple[str, Params]]) -> DataFrame:
    """Replace the candidate index by its family and parameter key."""
    families = F.array(*[F.lit(f) for f, _ in wanted])
    labels = F.array(*[F.lit(REGISTRY[f].candidate_key(p)) for f, p in wanted])
    pick = lambda arr: F.element_at(arr, F.col("cand") + 1)
    return df.withColumns({"family": pick(families), "params_key": pick(labels)}).drop("cand")


def candidate_id() -> Column:
    return F.concat_ws("__", "family", "symbol", "params_key")
