"""Connected components by alternating stars, each round written to the shared folder; nothing of the graph goes to the driver.

A star's centre with very many edges is no one task's: minima are combined before they are shuffled, and centres meet their edges by ``spread_join``.

Defined results: nulls at either end: no edge; repeated edges, both directions, an edge to itself: count once or not at all; an empty table: no
rows; extra columns: ignored. Node types need an order only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import discard, spread_join, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node and root, the smallest node that it reaches; nodes without an edge to another are left out."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = _both_ways(edges)
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = spread_join(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        # small star: smaller neighbours and the node itself go to the smallest of them
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = spread_join(large, lower, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "links")
        same = edges.count() == after.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(edges, least, large, lower)
        if same:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after
