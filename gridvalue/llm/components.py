"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al., 2014): each links the
neighbours of every node to the smallest of them, so a component of n nodes is a
star after O(log n) rounds. A hub's neighbours are never gathered: the smallest
neighbour is an aggregate that is joined back to the edges, and AQE can split that
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import settle

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or smaller) neighbours of each node to its smallest neighbour."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = seen.join(least, "a").where(F.col("b") > F.col("a"))
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b) the smallest node it reaches.

    Self-loops, repeated edges and both directions are allowed; nodes of no other
    edge have no row. Raises if the edges have not settled after 60 rounds, which
    components of over 2**60 nodes would need.
    """
    edges = settle(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(MAX_ROUNDS):
        edges = settle(_star(_star(edges, True), False), "edges")
        now = edges.agg(*mark).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
