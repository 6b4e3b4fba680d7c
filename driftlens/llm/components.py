"""Connected components of a graph given as edges, by alternating large and small stars on DataFrames.

Each round is two aggregations with map-side combine and two joins on the node. A hub costs the aggregation one partial row
a task; what it yields is written before it is joined, as adaptive execution splits a hub's rows only where both sides of a
join come straight from a shuffle. Rounds are written to the shared folder; their number grows with the logarithm of the
longest path, and nothing but a count a round reaches the driver. Edges that are stars already take no round, so the result
may go in again with further edges at the cost of what these join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import discard, materialize


def _least(both: DataFrame) -> DataFrame:
    return materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), written. Large: a node's larger neighbours point to its least one. Small: itself and its smaller ones do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(both)
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    made = materialize(moved.where("u <> v").distinct(), "stars")
    discard(least)
    return made


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end u stands in one edge, and is no smaller end v: then each v is the least of its component."""
    ends = edges.select(F.posexplode(F.array("u", "v")).alias("side", "node"))
    nodes = ends.groupBy("node").agg(F.sum(1 - F.col("side")).alias("as_u"), F.max("side").alias("as_v"))
    return nodes.where("as_u > 1 or as_u = 1 and as_v = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of edges (u, v) but the roots; loops and repeated edges are fine."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        large = _star(edges, True)
        discard(edges)
        edges = _star(large, False)
        discard(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
