"""Connected components by alternating large and small stars: labels travel by joins, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. edges: a, b, of one sortable type.

    Each round points every node's larger neighbours, then its smaller ones, at its least neighbour; rounds end when
    every edge points at a root. The least neighbour is a combining minimum, so a node with a third of all edges is
    reduced before the shuffle, and the join back to its edges is one that adaptive execution splits."""
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: every neighbour above a node is joined to the node's least neighbour or itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        # small star: a node and its smaller neighbours are joined to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(edges, large)
        # done when every node points once, at a root
        edges = after
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        forked = edges.groupBy("a").count().where("count > 1")
        if not inner.limit(1).count() and not forked.limit(1).count():
            break
    found = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
