"""Connected components of a graph of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of its component, for every node that has an edge.

    Each round takes the least label among a node and its neighbours, then follows labels one step further
    (a label is itself a node), so paths shrink geometrically. Rounds go through tables in the shared folder.
    """
    both = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").union(edges.select(F.col(b), F.col(a)).where(F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("node"), F.least("u", "_m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("_l")), "v").groupBy("u").agg(F.min("_l").alias("_m"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "_m").alias("_to"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_j"))
        nxt = materialize(
            lower.join(jump, F.col("_to") == F.col("_n")).select("node", F.least("_to", "_j").alias("_new"), (F.least("_to", "_j") < F.col("label")).alias("_moved")), "labels"
        )
        labels = nxt.select("node", F.col("_new").alias("label"))
        if nxt.where("_moved").isEmpty():
            return labels


def extend(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of the graph whose components so far are labels, with more edges (a, b): only labels are linked anew."""
    for side in "ab":
        edges = edges.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    top = components(edges.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    moved = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return materialize(moved.union(top.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
