"""Connected components of a graph of links, by contraction: no part of the graph is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) as (node, label): label is the smallest node that node reaches.

    Each round every node points to its smallest neighbour or itself, pointers are followed to their ends by doubling, and
    the edges are rewritten to what their ends point to; those that became loops go. Of the nodes that still have edges at
    most half are left after a round, even along a chain, so few rounds are needed. Only minima are aggregated, which combine before the
    shuffle, so that a node with very many links is no hot spot. Loops, repeated edges and an empty table are fine;
    edges with a null end are left out. Nodes without edges are not in the result.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        down = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        point, moving = cut(down), True
        while moving:  # every pointer is followed to its end; each time the ways that are left halve
            far = point.select(F.col("node").alias("to"), F.col("to").alias("to2"))
            point = cut(point.select("node", "to").join(far, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("to2") != F.col("to")).alias("moved")))
            moving = not point.where("moved").isEmpty()
        point = point.select("node", "to")
        if labels is None:
            labels = point.select("node", F.col("to").alias("label"))
        else:
            step = point.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        pa, pb = point.select(F.col("node").alias("a"), F.col("to").alias("ta")), point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(pa, "a").join(pb, "b").where("ta <> tb")
        edges = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
