"""Connected components of a graph given as a table of edges, all on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import settle


def _state(edges: DataFrame) -> tuple:
    """The number of edges and two sums that tell one set of edges from another."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("b", "a")).alias("x"),
    ).first()
    return row["n"], row["s"], row["x"]


def _stars(edges: DataFrame, neighbours: DataFrame, keep: Column) -> DataFrame:
    """Every neighbour of a node that ``keep`` allows, and the node, linked to the node's least neighbour."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a").filter(keep)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): every node with an edge and its component's least node.

    Alternates large-star and small-star steps until the edges stand still: a number of rounds that
    grows with the logarithm of a component's size. A node's neighbours are never gathered: their
    least one comes from a combining aggregate, and the join that follows can be split where a node
    has very many. Each round is settled in the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    edges = settle(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = settle(_stars(both, both, F.col("b") > F.col("a")).distinct(), "large-star")
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        small = _stars(large, large, F.col("b") < F.col("a")).unionByName(own)
        edges = settle(small.distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
