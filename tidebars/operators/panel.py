"""Ordered work inside one key without putting one key into one task.

Bars are numbered once per key. After that a series is cut into blocks of ``block_rows``
bars, and each block also receives the tail of its predecessor (the halo). Every rolling
window then partitions by (key, block): a long series spreads over many tasks, all
windows of one panel share a single shuffle, and results do not depend on the cut.

A key holds at most one bar per interval of its calendar (a century of hourly bars is
under a million rows), which bounds the numbering pass itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import DoubleType, StructField, StructType

from tidebars.session import fan_out

MIN_BLOCK_ROWS = 512


@dataclass(frozen=True)
class Recursion:
    """e[t] = e[t-1] + gain * (x[t] - e[t-1]) from e = x at bar ``seed``; null before bar ``ready``. A missing x counts as 0.

    A block's first row starts anew, so its halo has to be long enough for what came before to have faded.
    """

    col: str
    gain: float
    seed: int
    ready: int

    def __str__(self) -> str:
        return self.col


def recursions(df: DataFrame, keys: tuple[str, ...], lanes: dict[str, Recursion]) -> DataFrame:
    """Add recursive columns to blocked bars: all lanes of a block advance together, one bar a step."""
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in lanes]])
    inputs = list(dict.fromkeys(lane.col for lane in lanes.values()))
    place = [inputs.index(lane.col) for lane in lanes.values()]
    gain, seed, ready = (np.array([getattr(lane, f) for lane in lanes.values()]) for f in ("gain", "seed", "ready"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        bar = table["bar_no"].to_numpy()
        x = np.nan_to_num(np.stack([table[c].to_numpy().astype(np.float64) for c in inputs], axis=1))
        start = np.searchsorted(bar, seed)
        last, e, out = int(start.max()), np.zeros(len(lanes)), np.empty((len(bar), len(lanes)))
        for i in range(len(bar)):
            step = gain if i > last else np.where(i < start, 0.0, np.where(i == start, 1.0, gain))
            e += step * (x[i, place] - e)
            out[i] = e
        out[bar[:, None] < ready] = np.nan
        for k, name in enumerate(lanes):
            table = table.append_column(name, pa.array(out[:, k], pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*keys, "blk").applyInArrow(run, schema)


def number_bars(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add the dense 0-based ``bar_no`` and what its neighbours and series ends supply."""
    w = Window.partitionBy(*keys).orderBy("ts")
    whole = Window.partitionBy(*keys)
    return bars.withColumns(
        {
            "bar_no": (F.row_number().over(w) - 1).cast("int"),
            "prev_ts": F.lag("ts").over(w),
            "next_open": F.lead("open").over(w),
            "first_ts": F.min("ts").over(whole),
            "last_ts": F.max("ts").over(whole),
        }
    )


class Panel:
    """Blocked bars plus the columns asked for so far.

    Columns are kept aside and added in as few steps as their dependencies allow, since
    every step on a deep plan is analysed anew and windows added together share a pass.
    With ``in_lanes``, recursive columns are lanes of one Arrow kernel per step; else they are windows.
    """

    def __init__(self, df: DataFrame, keys: tuple[str, ...], in_lanes: bool = False) -> None:
        self._df, self.keys, self.in_lanes = df, keys, in_lanes
        self._names = set(df.columns)
        self._layers: list[dict[str, Column | Recursion]] = []
        self._depth: dict[str, int] = {}

    @property
    def df(self) -> DataFrame:
        out = self._df
        for layer in self._layers:
            lanes = {n: c for n, c in layer.items() if isinstance(c, Recursion)}
            out = out.withColumns({n: c for n, c in layer.items() if n not in lanes})
            out = recursions(out, self.keys, lanes) if lanes else out
        return out

    @property
    def order(self):
        return Window.partitionBy(*self.keys, "blk").orderBy("bar_no")

    def rows(self, n: int):
        """The current bar and the n-1 before it."""
        return self.order.rowsBetween(-(n - 1), 0)

    def lag(self, col: str | Column, k: int = 1) -> Column:
        return F.lag(col, k).over(self.order)

    def has(self, name: str) -> bool:
        return name in self._names

    def add(self, **cols: Column | Recursion) -> "Panel":
        """Add the columns that are not there yet, so shared indicators are built once."""
        for name, col in cols.items():
            if name in self._names:
                continue
            used = set(re.findall(r"\w+", str(col))) & self._depth.keys()
            depth = 1 + max((self._depth[u] for u in used), default=-1)
            while len(self._layers) <= depth:
                self._layers.append({})
            self._layers[depth][name] = col
            self._depth[name] = depth
            self._names.add(name)
        return self

    def settle(self) -> DataFrame:
        """The bars of each block without the halo."""
        return self.df.filter(~F.col("halo")).drop("halo")


def make_panel(
    numbered: DataFrame,
    keys: tuple[str, ...] = ("symbol",),
    lookback: int = 1,
    block_rows: int | None = None,
    in_lanes: bool = False,
) -> Panel:
    """Cut numbered bars into blocks whose halo covers ``lookback`` earlier bars."""
    size = max(block_rows or MIN_BLOCK_ROWS, lookback)
    if block_rows is None:
        size = max(size, 4 * lookback)
    own = (F.col("bar_no") / size).cast("int")
    in_tail = F.pmod("bar_no", F.lit(size)) >= size - lookback
    df = (
        numbered.withColumn("own", own)
        .withColumn("blk", F.explode(F.when(in_tail, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
        .withColumn("halo", F.col("blk") != F.col("own"))
        .drop("own")
    )
    # An explicit count: candidates multiply rows inside these tasks, so partitions must
    # not be merged by the size they have before that.
    return Panel(df.repartition(fan_out(df.sparkSession), *keys, "blk"), tuple(keys), in_lanes)
