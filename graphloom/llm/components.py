"""Connected components by repeated contraction to the least neighbour, with DataFrames.

Ids are hashes, so the least neighbour is a random one and each round leaves a fraction of the nodes. A round is a
map-side combined minimum and two joins; its result is a written table, and nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, scratch, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); loops mention a node that has no other edge."""
    with scratch(edges.sparkSession):
        return kept(_contracted(edges))


def _contracted(edges: DataFrame) -> DataFrame:
    rounds: list[DataFrame] = []
    now = written(edges.select("a", "b").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        rounds.append(parent)
        left = parent.select(F.col("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        now = written(now.where("a <> b").join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if not now.limit(1).count():
            break
    # in the last round every parent is its own parent, as all edges have fallen together
    label = rounds[-1].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for parent in reversed(rounds[:-1]):
        up = label.withColumnsRenamed({"node": "p", "component": "c"})
        label = parent.join(up, "p", "left").select(F.col("a").alias("node"), F.coalesce("c", "p").alias("component"))
    return written(label, "components")

