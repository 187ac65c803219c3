"""Connected components of an edge list by repeated contraction, all in DataFrames.

Every node points at its smallest neighbour, pointers are followed twice, and the
edges are rewritten between the nodes pointed at. The smallest node of a component
always points at itself, so when no edge is left each node has reached it. The edge
list at least halves its nodes each round, and no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long, either order, repeats allowed) to (node, component_id).

    ``component_id`` is the smallest node reachable. Nodes without an edge to another
    node do not appear; null ends are ignored.
    """
    links = settle(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to"))
        above = parent.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moved = settle(parent.join(above, "to").select("node", "root"))
        labels = (
            moved
            if labels is None
            else settle(
                labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
                .select("node", F.coalesce("new", "root").alias("root"))
            )
        )
        a, b = (moved.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        links = settle(
            links.join(a, "a").join(b, "b").where("a_root <> b_root")
            .select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b"))
            .distinct()
        )
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return labels.select("node", F.col("root").alias("component_id"))


def forest(n: int, parts):
    """Labels of ``n`` items after all index pairs in ``parts`` (an iterable of (i, j) arrays) are joined.

    The label is the smallest index reachable; memory holds one part at a time.
    """
    import numpy as np

    label = np.arange(n)
    for i, j in parts:
        while True:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
            if (label[i] == label[j]).all():
                break
    return label
