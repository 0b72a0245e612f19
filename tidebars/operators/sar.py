"""Parabolic stop-and-reverse: a recursion over real-valued state.

Its state does not compose, so blocks are scanned in order per series, but only block
by block: each task scans one (series, block) from a guessed start state, and the guess
of a block is then compared with what its predecessor really ended in. Runs started from
different states fall onto the same path after a reversal or two, so nearly all guesses
hold after the first pass; the others are scanned again until none is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidebars.session import materialize

SAR_BLOCK_ROWS = 65536


def scan_sar(high, low, step, cap, state):
    """Direction after each bar, and the end state.

    ``high``/``low`` start with the two bars before the first scanned one; ``state`` is
    (direction, stop, extreme, acceleration) after the second of them.
    """
    up, stop, extreme, accel = state[0] > 0, state[1], state[2], state[3]
    out = np.zeros(len(high) - 2, dtype=np.int8)
    for i in range(2, len(high)):
        hi, lo = high[i], low[i]
        stop += accel * (extreme - stop)
        stop = min(stop, low[i - 1], low[i - 2]) if up else max(stop, high[i - 1], high[i - 2])
        reversed_ = lo < stop if up else hi > stop
        if reversed_:
            up, stop, accel = not up, extreme, step
            extreme = hi if up else lo
        elif (hi > extreme) if up else (lo < extreme):
            extreme = hi if up else lo
            accel = min(accel + step, cap)
        out[i - 2] = 1 if up else -1
    return out, (1.0 if up else -1.0, stop, extreme, accel)


def _opening(pdf: pd.DataFrame, step: float):
    """State after the second bar of a series (or, as a guess, of a block's lead-in)."""
    close, high, low = pdf["close"].to_numpy(), pdf["high"].to_numpy(), pdf["low"].to_numpy()
    up = close[1] > close[0]
    return (1.0, low[0], high[1], step) if up else (-1.0, high[0], low[1], step)


def sar_codes(numbered: DataFrame, keys: tuple[str, ...], params: list[dict], block_rows: int = SAR_BLOCK_ROWS) -> DataFrame:
    """Add ``sar_codes``: one direction digit (0, 1, 2 = -1, 0, 1) per parameter set."""
    grid = [(float(p["acceleration_step"]), float(p["acceleration_max"])) for p in params]
    warm = min(512, block_rows)
    own = (F.col("bar_no") / block_rows).cast("int")
    narrow = numbered.select(*keys, "bar_no", "high", "low", "close").withColumn("own", own)
    in_tail = F.pmod("bar_no", F.lit(block_rows)) >= block_rows - warm
    blocks = narrow.withColumn(
        "sar_blk", F.explode(F.when(in_tail, F.array("own", F.col("own") + 1)).otherwise(F.array("own")))
    )
    types = dict(numbered.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    state_type = "array<array<double>>"
    out_schema = f"{key_schema}, sar_blk int, bar_nos array<int>, codes array<string>, begin {state_type}, finish {state_type}"

    def scan(key, pdf, given=None):
        pdf = pdf.sort_values("bar_no")
        lead = int((pdf["own"] < pdf["sar_blk"]).sum())
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        digits, begins, finishes = [], [], []
        for j, (step, cap) in enumerate(grid):
            if len(pdf) - lead == 0:
                continue
            if lead == 0:
                out = np.ones(len(pdf), dtype=np.int8)
                state = (0.0, 0.0, 0.0, 0.0)
                begin = state
                if len(pdf) >= 2:
                    state = _opening(pdf, step)
                    out[1] = 1 + int(state[0])
                    if len(pdf) > 2:
                        rest, state = scan_sar(high, low, step, cap, state)
                        out[2:] = rest + 1
            else:
                if given is None:
                    begin = _opening(pdf, step)
                    if lead > 2:
                        _, begin = scan_sar(high[:lead], low[:lead], step, cap, begin)
                else:
                    begin = tuple(given[j])
                rest, state = scan_sar(high[lead - 2 :], low[lead - 2 :], step, cap, begin)
                out = rest + 1
            digits.append(out)
            begins.append(list(map(float, begin)))
            finishes.append(list(map(float, state)))
        if not digits:
            return pd.DataFrame(columns=[*keys, "sar_blk", "bar_nos", "codes", "begin", "finish"], dtype=object)
        codes = ["".join(col) for col in np.array(digits).T.astype(str)]
        row = dict(zip([*keys, "sar_blk"], key))
        row.update(bar_nos=pdf["bar_no"].to_numpy()[lead:], codes=codes, begin=begins, finish=finishes)
        return pd.DataFrame([row])

    first = blocks.groupBy(*keys, "sar_blk").applyInPandas(lambda key, pdf: scan(key, pdf), out_schema)
    first = _settle(materialize(first, "sar"), blocks, keys, scan, out_schema)
    flat = first.select(*keys, F.explode(F.arrays_zip(F.col("bar_nos").alias("b"), F.col("codes").alias("c"))).alias("z")).select(
        *keys, F.col("z.b").alias("bar_no"), F.col("z.c").alias("sar_codes")
    )
    return numbered.join(flat, [*keys, "bar_no"], "left")


def _settle(done: DataFrame, blocks: DataFrame, keys, scan, schema) -> DataFrame:
    """Scan again the blocks whose guessed start differs from their predecessor's end."""
    while True:
        ends = done.select(*keys, (F.col("sar_blk") + 1).alias("sar_blk"), F.col("finish").alias("given"))
        wrong = done.join(ends, [*keys, "sar_blk"]).filter(F.col("begin") != F.col("given")).select(*keys, "sar_blk", "given")
        if wrong.isEmpty():
            return done
        todo = blocks.join(wrong, [*keys, "sar_blk"])

        def again(key, pdf):
            return scan(key, pdf.drop(columns="given"), [list(v) for v in pdf["given"].iloc[0]])

        redone = todo.groupBy(*keys, "sar_blk").applyInPandas(again, schema)
        kept = done.join(wrong.select(*keys, "sar_blk"), [*keys, "sar_blk"], "left_anti")
        done = materialize(kept.unionByName(redone), "sar")
