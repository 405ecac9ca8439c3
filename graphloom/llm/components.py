"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def _stars(pairs: DataFrame, upward: bool) -> DataFrame:
    """Link the neighbours of each node a to the least of them.

    upward: pairs holds both directions and only neighbours above the node
    move.  Both sides of the join are read from checkpoints, so that
    adaptive execution can split the rows of a hub.
    """
    least = cut(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n"))
    at = pairs.join(least, F.col("a") == F.col("n"))
    if upward:
        made = at.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = at.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return cut(made.where("a <> b").distinct())


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): each node of an edge with the least node that it reaches.

    Nodes are integers; edges with a null end or from a node to itself count
    for nothing, repeated edges for one.  Each round is a few joins and
    aggregations with map-side combining; no group is gathered anywhere.
    """
    e = edges.select(F.expr(f"if({src} > {dst}, {src}, {dst})").alias("a"), F.expr(f"if({src} > {dst}, {dst}, {src})").alias("b"))
    e = cut(e.where("a <> b").distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _stars(both, upward=True)
        e = _stars(up, upward=False)
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
