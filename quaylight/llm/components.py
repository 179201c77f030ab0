"""Connected components of a set of links, as the smallest member of each.

Every round joins each node to the smallest label around it and then follows labels of labels, so a chain
shortens by halves. Rounds end when no label changes; state is written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b: bigint); nulls link nothing, repeats and loops are harmless.

    Edges are contracted: after a round they run between labels only, so they get fewer each time.
    """
    edges = stored(_tidy(links.where("a is not null and b is not null")), "links")
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Every node points to its smallest neighbour or itself: no cycles, so these are trees.
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        parent = stored(lowest.select("a", F.least("a", "low").alias("label")), "parents")
        parent = _rooted(parent)
        parents.append(parent)
        up = parent.select("a", "label")
        moved = edges.join(up, "a").select(F.col("label").alias("a"), F.col("b").alias("c"))
        moved = moved.join(up.select(F.col("a").alias("c"), F.col("label").alias("b")), "c").select("a", "b")
        rest = stored(_tidy(moved), "links")
        discard(edges)
        edges = rest
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = parents[0]
    for later in parents[1:]:
        follow = later.select(F.col("a").alias("label"), F.col("label").alias("top"))
        labels = labels.join(follow, "label", "left").select("a", F.coalesce("top", "label").alias("label"))
    return labels.select(F.col("a").alias("node"), "label")


def _tidy(links: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return links.select(low.alias("a"), high.alias("b")).where("a < b").distinct()


def _rooted(parent: DataFrame) -> DataFrame:
    """Pointers followed to the roots by doubling."""
    while True:
        above = parent.select(F.col("a").alias("label"), F.col("label").alias("top"))
        longer = stored(parent.join(above, "label").select("a", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "parents")
        more = not longer.where("moved").isEmpty()
        discard(parent)
        parent = longer.drop("moved")
        if not more:
            return parent
