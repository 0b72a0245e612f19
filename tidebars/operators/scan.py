"""Rows numbered in a total order without one task seeing them all.

Rows are dealt out by ranges of the order columns and sorted inside their range; the number of a row is its place there
plus the rows of all ranges before. A key with most rows spreads over many ranges, and what meets in one place is one
count per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebars.session import materialize

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def number_rows(df: DataFrame, order: list[Column], name: str = "rank", first: int = 1) -> DataFrame:
    """``df`` and the long ``name``: 1, 2, 3, ... along ``order``. Rows equal in all order columns are numbered in any order.

    The sorted rows are written once to the shared folder, so the counts and the places come from the same cut.
    """
    spot = f"{name}__spot"
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(spot, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(spot), _PLACE_BITS)
    sizes = placed.groupBy(part.alias(f"{name}__part")).agg(F.count("*").alias(f"{name}__n"))
    # One row per range, a number that the configuration bounds.
    offsets = sizes.select(f"{name}__part", (F.sum(f"{name}__n").over(Window.orderBy(f"{name}__part")) - F.col(f"{name}__n")).alias(f"{name}__before"))
    place = F.col(spot).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    joined = placed.withColumn(f"{name}__part", part).join(F.broadcast(offsets), f"{name}__part")
    return joined.withColumn(name, F.col(f"{name}__before") + place + first).drop(spot, f"{name}__part", f"{name}__before")
