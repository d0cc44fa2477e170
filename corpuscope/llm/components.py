"""Connected components by contraction; only DataFrame joins and groupings, nothing of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import release, staged


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node in ``edges`` (a, b: bigint, none null).

    In each round every node points to its smallest neighbour (or itself) and, one step further, to that one's; the
    edges are then drawn between what their ends point to. Loops and repeats fall away, so the graph shrinks until
    no edge is left. Every round is written to the shared folder, and what it was made of is removed. Groupings are by (node) with partial sums of one
    number, and in each join one side has one row per node, so a node with very many edges can be split.
    """
    a, b = F.col("a"), F.col("b")
    edges = staged(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        lowest = staged(both.groupBy("a").agg(F.least(a, F.min("b")).alias("p")).select(a.alias("n"), "p"), "parents")
        second = lowest.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        parents = lowest.join(second, "p").select("n", F.col("pp").alias("p"))
        if labels is None:
            labels = staged(parents.select(F.col("n").alias("node"), F.col("p").alias("component")), "labels")
        else:
            joined, old = labels.join(parents, F.col("component") == F.col("n"), "left"), labels
            labels = staged(joined.select("node", F.coalesce("p", "component").alias("component")), "labels")
            release(old)
        left = parents.select(F.col("n").alias("a"), F.col("p").alias("pa"))
        right = parents.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        old, edges = edges, staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        release(old, lowest)
        if edges.isEmpty():
            release(edges)
            return labels
