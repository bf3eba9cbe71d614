"""Connected components of a table of links by repeated contraction.

Each round maps every node to the smallest of itself and its neighbours, replaces links by links between
the nodes mapped to, and carries the labels along; rounds end when no link is left. Neighbours are
aggregated before the shuffle, so a hub with many links is no hot group. Every round's links and labels are
written to the shared folder. Nodes without a link have no row in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links(a, b)``; a component is named by its smallest node."""
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = materialize(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component")), "labels"
    )
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        down = both.groupBy(F.col("a").alias("from")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        down = materialize(down.filter(F.col("from") != F.col("to")), "down")
        before = (labels, edges, down)
        labels = materialize(
            labels.join(down, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component")), "labels"
        )
        a, b = (down.select(F.col("from").alias(f"{s}f"), F.col("to").alias(f"{s}t")) for s in ("a", "b"))
        moved = (
            edges.join(a, F.col("a") == F.col("af"), "left")
            .join(b, F.col("b") == F.col("bf"), "left")
            .select(F.coalesce("at", "a").alias("x"), F.coalesce("bt", "b").alias("y"))
            .filter("x <> y")
        )
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(*before)
    discard(edges)
    return labels
