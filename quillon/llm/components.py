"""Connected components of a link table, by contraction.

Each round every node points to the least of its neighbours and itself, pointers are followed once more, and links
between nodes are replaced by links between what they point to.  A node that points elsewhere is gone from the next
round's names, so rounds shrink the graph by half at least.  The least node of a component points to itself
throughout and gives the component its name.  Rounds are written to the shared folder; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """*links* (a, b longs, in any order, repeats and loops allowed) -> node, component for every node in a link.

    Nulls link nothing; an empty table gives an empty result.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "pointers")
        further = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        up = staged(near.join(further, "p").select("a", F.col("pp").alias("p")), "pointers")
        discard(near)
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            now = labels.join(up.withColumnRenamed("a", "component"), "component", "left")
            labels = staged(now.select("node", F.coalesce("p", "component").alias("component")), "labels")
        ends = edges.join(up.withColumnRenamed("p", "pa"), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        ends = ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        old, edges = edges, staged(ends.distinct(), "links")
        discard(old)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
