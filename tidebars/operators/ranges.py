"""Backtest summaries that add up, so that any window of any candidate is a sum of stored pieces.

A piece is an interval of bars of one series. Its summary holds, for many candidates side by side, sums and powers of
net returns, the growth, highest, lowest and deepest point of NAV (also under stressed costs and returns), and the trades:
those that begin and end inside as counts and sums, the first and the last run kept open. Two neighbouring pieces
combine into the summary of both; combining is associative. Bars are thus folded once, in blocks, and in- and
out-of-sample, stress windows, folds and the whole sample follow from a few summaries each.

Signals are three-state maps (a held rule's bar, or a constant for a level rule). Maps compose, so blocks are folded
apart from each other and learn the state they start in from the small table of block ends.

A NAV that reaches zero is a total loss: its drawdown is -1 from then on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebars.operators.backtest import COMMISSION_BPS

BLOCK_ROWS = 512
#: Blocks per node of the second level.
FAN = 256
TOP = 5
#: Stressed returns: gross returns and spreads are scaled, commission is not.
RETURN_MULTIPLIER, SPREAD_MULTIPLIER = 1.5, 2.0

FIELDS = (
    "sum", "sq", "cube", "fourth", "cost", "growth", "high", "low", "dip", "s_growth", "s_high", "s_low", "s_dip", "worst", "s_worst",
    "first_dir", "first_growth", "last_dir", "last_growth", "single", "trades", "profit", *[f"top{i}" for i in range(TOP)],
)
AT = {name: i for i, name in enumerate(FIELDS)}
_TOPS = slice(AT["top0"], AT["top0"] + TOP)

SERIES = ("chunk", "symbol", "part", "fold")


def _images() -> np.ndarray:
    """For every character of a signal string: where -1, 0, 1 (as 0, 1, 2) go."""
    out = np.ones((256, 3), np.uint8)
    for digit in range(3):
        out[ord("0") + digit] = digit
    for code in range(12):
        out[ord("a") + code] = (1 if code // 6 else 0), code % 3, (1 if code // 3 % 2 else 2)
    return out


IMAGES = _images()


def _maps(table: pa.Table) -> np.ndarray:
    """Signal characters of a block, bars x candidates."""
    raw = b"".join(table["maps"].to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(table.num_rows, -1)


def block_ends(key: tuple, table: pa.Table) -> pa.Table:
    """The composed map after the last bar of a block and after the last but one."""
    table = table.sort_by("bar_no")
    now = np.tile(np.arange(3, dtype=np.uint8), (len(table["maps"][0].as_py()), 1))
    before = now
    for bar in _maps(table):
        before, now = now, np.take_along_axis(IMAGES[bar], now, axis=1)
    return pa.Table.from_pydict({**_keys(key, (*SERIES, "blk")), "end": [now.tobytes()], "before": [before.tobytes()]}, schema=_ENDS)


def _keys(key: tuple, names: tuple[str, ...]) -> dict:
    return {n: [k.as_py()] for n, k in zip(names, key)}


_SERIES_FIELDS = [("chunk", pa.int32()), ("symbol", pa.string()), ("part", pa.string()), ("fold", pa.int32())]
_ENDS = pa.schema([*_SERIES_FIELDS, ("blk", pa.int32()), ("end", pa.binary()), ("before", pa.binary())])
_SERIES_SQL = "chunk int, symbol string, part string, fold int"


def block_starts(key: tuple, table: pa.Table) -> pa.Table:
    """The state every block of a series starts in, and the one before it; series start flat."""
    rows = table.sort_by("blk").select(["blk", "end", "before"]).to_pylist()
    flat = np.ones(len(rows[0]["end"]) // 3, np.uint8)
    state, prior, starts, priors = flat, flat, [], []
    each = np.arange(len(flat))
    for r in rows:
        starts.append(state.tobytes())
        priors.append(prior.tobytes())
        prior = np.frombuffer(r["before"], np.uint8).reshape(-1, 3)[each, state]
        state = np.frombuffer(r["end"], np.uint8).reshape(-1, 3)[each, state]
    names = {n: [k.as_py()] * len(rows) for n, k in zip(SERIES, key)}
    return pa.Table.from_pydict({**names, "blk": [r["blk"] for r in rows], "state": starts, "prior": priors}, schema=_STARTS)


_STARTS = pa.schema([*_SERIES_FIELDS, ("blk", pa.int32()), ("state", pa.binary()), ("prior", pa.binary())])


def held(maps: np.ndarray, state: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Positions held before, during and after: row i + 1 is held during bar i, row i during the bar before it."""
    out = np.empty((len(maps) + 2, maps.shape[1]), np.int8)
    out[0], out[1] = prior, state
    for i, bar in enumerate(maps):
        out[i + 2] = IMAGES[bar, out[i + 1]]
    return out - np.int8(1)


def costed(table: pa.Table, executed: np.ndarray, before: np.ndarray, commission: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gross returns, spread cost, commission cost (bars x candidates) and market returns of bars that have a next open."""
    open_, after, spread = (table[c].to_numpy() for c in ("open", "next_open", "fill_spread_fraction"))
    if not np.all(spread >= 0):
        raise ValueError("fill_spread_fraction is missing or negative")
    market = np.nan_to_num(np.divide(after, open_, out=np.full(len(open_), np.nan), where=open_ != 0) - 1)
    sides = np.abs(executed - before).astype(np.float64)
    return executed * market[:, None], sides * (spread / 2)[:, None], sides * commission, market


def _nav(net: np.ndarray) -> tuple[np.ndarray, ...]:
    nav = np.cumprod(1 + net, axis=0)
    low = nav.min(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        dip = np.where(low > 0, (nav / np.maximum.accumulate(nav, axis=0)).min(axis=0), 0.0)
    return nav[-1], nav.max(axis=0), low, dip


def summarize(executed: np.ndarray, gross: np.ndarray, spread: np.ndarray, commission: np.ndarray) -> np.ndarray:
    """The summary (fields x candidates) of one piece."""
    n, count = executed.shape
    cost = spread + commission
    net = gross - cost
    out = np.zeros((len(FIELDS), count))
    out[AT["sum"]], out[AT["sq"]], out[AT["cube"]], out[AT["fourth"]] = (np.sum(net**k, axis=0) for k in (1, 2, 3, 4))
    out[AT["cost"]] = cost.sum(axis=0)
    stressed = gross * RETURN_MULTIPLIER - spread * SPREAD_MULTIPLIER - commission
    out[AT["growth"] : AT["dip"] + 1], out[AT["s_growth"] : AT["s_dip"] + 1] = _nav(net), _nav(stressed)
    out[AT["worst"]], out[AT["s_worst"]] = net.min(axis=0), stressed.min(axis=0)
    # Runs of one position, candidate by candidate.
    opens = np.ones((count, n), bool)
    opens[:, 1:] = (executed[1:] != executed[:-1]).T
    begin = np.flatnonzero(opens)
    growth = np.multiply.reduceat((1 + net).T.ravel(), begin)
    side, cand = executed.T.ravel()[begin], begin // n
    first = np.searchsorted(cand, np.arange(count))
    last = np.append(first[1:], len(cand)) - 1
    out[AT["first_dir"]], out[AT["first_growth"]], out[AT["last_dir"]], out[AT["last_growth"]] = side[first], growth[first], side[last], growth[last]
    out[AT["single"]] = first == last
    inner = side != 0
    inner[first] = inner[last] = False
    out[AT["trades"]] = np.bincount(cand[inner], minlength=count)
    won = np.flatnonzero(inner & (growth > 1))
    won = won[np.lexsort((-growth[won], cand[won]))]
    out[AT["profit"]] = np.bincount(cand[won], weights=growth[won] - 1, minlength=count)
    place = np.arange(len(won)) - np.searchsorted(cand[won], cand[won])
    best = place < TOP
    out[_TOPS][place[best], cand[won[best]]] = growth[won[best]] - 1
    return out


def _close(s: np.ndarray, which: np.ndarray, side: np.ndarray, growth: np.ndarray) -> None:
    """Count one more finished trade of the candidates ``which``."""
    ended = which & (side != 0)
    s[AT["trades"]] += ended
    gain = np.where(ended & (growth > 1), growth - 1, 0.0)
    s[AT["profit"]] += gain
    s[_TOPS] = -np.sort(-np.vstack([s[_TOPS], gain[None]]), axis=0)[:TOP]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summary of piece ``a`` followed by piece ``b``."""
    out = a.copy()
    for name in ("sum", "sq", "cube", "fourth", "cost", "trades", "profit"):
        out[AT[name]] += b[AT[name]]
    for name in ("worst", "s_worst"):
        out[AT[name]] = np.minimum(a[AT[name]], b[AT[name]])
    for p in ("", "s_"):
        g, h, lo, d = (AT[f"{p}{x}"] for x in ("growth", "high", "low", "dip"))
        turned = a[g] < 0  # a negative NAV turns what follows upside down
        out[g] = a[g] * b[g]
        out[h] = np.maximum(a[h], a[g] * np.where(turned, b[lo], b[h]))
        out[lo] = np.minimum(a[lo], a[g] * np.where(turned, b[h], b[lo]))
        with np.errstate(divide="ignore", invalid="ignore"):
            across = a[g] * b[lo] / a[h]
        out[d] = np.where(out[lo] > 0, np.minimum(np.minimum(a[d], b[d]), across), 0.0)
    out[_TOPS] = -np.sort(-np.vstack([a[_TOPS], b[_TOPS]]), axis=0)[:TOP]
    one, two = a[AT["single"]] > 0, b[AT["single"]] > 0
    same = a[AT["last_dir"]] == b[AT["first_dir"]]
    joined = a[AT["last_growth"]] * b[AT["first_growth"]]
    _close(out, same & ~one & ~two, a[AT["last_dir"]], joined)
    _close(out, ~same & ~one, a[AT["last_dir"]], a[AT["last_growth"]])
    _close(out, ~same & ~two, b[AT["first_dir"]], b[AT["first_growth"]])
    out[AT["first_growth"]] = np.where(same & one, joined, a[AT["first_growth"]])
    out[AT["last_dir"]] = b[AT["last_dir"]]
    out[AT["last_growth"]] = np.where(same & two, joined, b[AT["last_growth"]])
    out[AT["single"]] = same & one & two
    return out


def finished(s: np.ndarray) -> np.ndarray:
    """``s`` with its open runs counted as trades."""
    out = s.copy()
    every = np.ones(s.shape[1], bool)
    _close(out, every, s[AT["first_dir"]], s[AT["first_growth"]])
    _close(out, s[AT["single"]] == 0, s[AT["last_dir"]], s[AT["last_growth"]])
    return out


# ---------------------------------------------------------------- in Spark

_NODE = pa.schema([*_SERIES_FIELDS, ("piece", pa.int32()), ("blk", pa.int32()), ("n", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64()), ("summary", pa.binary())])
_NODE_SQL = f"{_SERIES_SQL}, piece int, blk int, n long, t0 long, t1 long, summary binary"


def starts(signals: DataFrame) -> DataFrame:
    """The states every (series, block) starts in. ``signals``: series keys, ``blk``, ``bar_no``, ``maps``."""
    ends = signals.select(*SERIES, "blk", "bar_no", "maps").groupBy(*SERIES, "blk").applyInArrow(block_ends, f"{_SERIES_SQL}, blk int, end binary, before binary")
    return ends.groupBy(*SERIES).applyInArrow(block_starts, f"{_SERIES_SQL}, blk int, state binary, prior binary")


def pieces(signals: DataFrame, start: DataFrame, commission_bps: float = COMMISSION_BPS) -> DataFrame:
    """Summaries of every piece of every block. ``signals`` also has bars and ``cuts``: sorted epoch seconds at which pieces begin."""

    def run(key: tuple, table: pa.Table, begin: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        state, prior = (np.frombuffer(begin[c][0].as_py(), np.uint8) for c in ("state", "prior"))
        positions = held(_maps(table), state, prior)
        valid = np.asarray(table["next_open"].is_valid())
        table, before, executed = table.filter(pa.array(valid)), positions[:-2][valid], positions[1:-1][valid]
        rows = {name: [] for name in _NODE.names}
        if table.num_rows:
            gross, spread, commission, _ = costed(table, executed, before, commission_bps / 1e4)
            t = table["t"].to_numpy()
            piece = np.searchsorted(np.array(table["cuts"][0].as_py() or [], np.int64), t, side="right")
            edges = np.flatnonzero(np.diff(piece, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(t)]):
                summary = summarize(executed[a:b], gross[a:b], spread[a:b], commission[a:b])
                for name, value in zip(_NODE.names, (*(k.as_py() for k in key[:4]), int(piece[a]), key[4].as_py(), int(b - a), int(t[a]), int(t[b - 1]), summary.tobytes())):
                    rows[name].append(value)
        return pa.Table.from_pydict(rows, schema=_NODE)

    both = signals.groupBy(*SERIES, "blk").cogroup(start.groupBy(*SERIES, "blk"))
    return both.applyInArrow(run, _NODE_SQL)


def _folded(table: pa.Table, order: list[tuple[str, str]]) -> tuple[int, int, int, np.ndarray]:
    rows = table.sort_by(order).select(["n", "t0", "t1", "summary"]).to_pylist()
    total = None
    for r in rows:
        s = np.frombuffer(r["summary"]).reshape(len(FIELDS), -1)
        total = s if total is None else combine(total, s)
    return sum(r["n"] for r in rows), rows[0]["t0"], rows[-1]["t1"], total


def second_level(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """Runs of ``fan`` blocks of one piece as one node each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, t0, t1, total = _folded(table, [("blk", "ascending")])
        return pa.Table.from_pydict({**_keys(key, (*SERIES, "piece", "blk")), "n": [n], "t0": [t0], "t1": [t1], "summary": [total.tobytes()]}, schema=_NODE)

    wide = nodes.withColumn("high", (F.col("blk") / fan).cast("int"))
    return wide.groupBy(*SERIES, "piece", "high").applyInArrow(run, _NODE_SQL)


RESULTS = ("n", "t0", "t1", *FIELDS)


def windows(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per candidate (``slot``) and window with ``RESULTS``. ``wanted``: symbol, part, ``win`` and the array ``in_pieces``."""
    schema = pa.schema([*_SERIES_FIELDS, ("win", pa.string()), ("slot", pa.int32()), ("n", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64()), *[(f, pa.float64()) for f in FIELDS]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, t0, t1, total = _folded(table, [("piece", "ascending"), ("blk", "ascending")])
        total = finished(total)
        count = total.shape[1]
        names = {k: [v.as_py()] * count for k, v in zip((*SERIES, "win"), key)}
        return pa.Table.from_pydict({**names, "slot": np.arange(count, dtype=np.int32), "n": [n] * count, "t0": [t0] * count, "t1": [t1] * count, **dict(zip(FIELDS, total))}, schema=schema)

    exploded = wanted.select("symbol", "part", "win", F.explode("in_pieces").alias("piece"))
    met = nodes.join(exploded, ["symbol", "part", "piece"])
    sql = f"{_SERIES_SQL}, win string, slot int, n long, t0 long, t1 long, " + ", ".join(f"{f} double" for f in FIELDS)
    return met.groupBy(*SERIES, "win").applyInArrow(run, sql)

