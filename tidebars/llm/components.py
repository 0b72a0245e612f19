"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the same key; neighbours of a hub are never gathered in one task
(the join with the one minimum of a hub can be split). Steps are written to the shared folder, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebars.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    far = both.where("v > u")
    return far.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them; edges point from larger to smaller."""
    least = _least(edges).select(F.col("u").alias("x"), "m")
    tied = edges.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node reachable) of every node with an edge, except the least ones themselves.

    ``edges`` has integer columns ``u`` and ``v`` in any order; loops, nulls and repeated edges are ignored.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _stars(now):
        now = materialize(_small(_large(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one node only and none of these points on: then each star is a component."""
    split = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    on = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return split.union(on).isEmpty()


def relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges: ends are replaced by their labels, the contracted edges are solved, labels are mapped on."""
    def end(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_label"))

    short = edges.join(end("u"), "u", "left").join(end("v"), "v", "left").select(
        F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")
    )
    more = components(short)
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(old.union(more.select("node", "component")).distinct(), "labels")
