"""Graph operators over edge tables (src, dst[, weight]); loops write each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.shared import materialize


def undirected(edges: DataFrame) -> DataFrame:
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(swapped).distinct()


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, level): nodes reachable from start (node), with the fewest hops; a start is at 0."""
    seen, level = materialize(start.select("node", F.lit(0).alias("level")).distinct(), "reach"), 0
    frontier = seen
    while True:
        level += 1
        step = frontier.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level")), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def shortest_distances(edges: DataFrame, start) -> DataFrame:
    """(node, dist, path): least weight from start and a path of that weight (the least such); weights are >= 0."""
    checked = edges.withColumn("weight", F.when(F.col("weight") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("weight")).cast("double"))
    known = materialize(edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0.0).alias("dist"), F.array(F.lit(start)).alias("path")), "dist")
    changed = known
    while True:
        step = changed.join(checked, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.concat("path", F.array("dst")).alias("path"))
        best = known.withColumn("old", F.lit(True)).union(step.withColumn("old", F.lit(False))).groupBy("node").agg(F.min(F.struct("dist", F.size("path").alias("_n"), "path", F.expr("NOT old").alias("new"))).alias("b"))
        known2 = materialize(best.select("node", "b.dist", "b.path", F.col("b.new").alias("new")), "dist")
        changed = known2.where("new").drop("new")
        known = known2.drop("new")
        if changed.isEmpty():
            return known


def valid_path(edges: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per row (path_id, path) whether each hop is an edge and the start is a node; an empty path is not valid."""
    hops = paths.select("path_id", F.posexplode_outer("path").alias("pos", "src"), F.col("path").alias("_p")).withColumn("dst", F.get("_p", F.col("pos") + 1)).drop("_p")
    known = edges.select("src", "dst").distinct().withColumn("_e", F.lit(True))
    start = nodes.select(F.col("node").alias("src")).distinct().withColumn("_n", F.lit(True))
    joined = hops.join(known, ["src", "dst"], "left").join(start, "src", "left")
    fits = F.when(F.col("pos").isNull(), False).when(F.col("dst").isNull(), F.coalesce("_n", F.lit(False))).otherwise(F.coalesce("_e", F.lit(False)))
    return joined.groupBy("path_id").agg(F.bool_and(fits).alias("valid"))


def is_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: whether the undirected graph is connected and has one edge less than nodes."""
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    seen = reach(undirected(edges.select("src", "dst")), nodes.orderBy("node").limit(1))
    n, m, r = nodes.select("node").distinct().agg(F.count("*").alias("n")), once.agg(F.count("*").alias("m")), seen.agg(F.count("*").alias("r"))
    return n.crossJoin(m).crossJoin(r).select((F.col("r") == F.col("n")).alias("connected"), (F.col("m") >= F.col("n")).alias("has_cycle_edges"), ((F.col("r") == F.col("n")) & (F.col("m") == F.col("n") - 1)).alias("is_tree"))


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: Boruvka rounds; ties by (weight, src, dst)."""
    once = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    once = materialize(once, "edges")
    label = materialize(once.select(F.col("src").alias("node")).union(once.select("dst")).distinct().select("node", F.col("node").alias("label")), "labels")
    tree = None
    while True:
        a, b = (label.select(F.col("node").alias(n), F.col("label").alias(f"l_{n}")) for n in ("src", "dst"))
        across = once.join(a, "src").join(b, "dst").where("l_src <> l_dst")
        e = F.struct("weight", "src", "dst")
        best = across.select(F.col("l_src").alias("c"), e.alias("e")).union(across.select(F.col("l_dst"), e)).groupBy("c").agg(F.min("e").alias("e"))
        chosen = materialize(best.select("e.src", "e.dst", "e.weight").distinct(), "chosen")
        if chosen.isEmpty():
            return tree if tree is not None else chosen
        tree = chosen if tree is None else tree.union(chosen)
        label = _spread(label, chosen)


def _spread(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that links connect: the least label of each."""
    a, b = (label.select(F.col("node").alias(n), F.col("label").alias(f"l_{n}")) for n in ("src", "dst"))
    pairs = links.join(a, "src").join(b, "dst").select("l_src", "l_dst")
    both = materialize(pairs.union(pairs.select("l_dst", "l_src")).distinct().toDF("u", "v"), "links")
    low = materialize(both.select(F.col("u").alias("c")).distinct().select("c", F.col("c").alias("to")), "low")
    while True:
        near = both.join(low.select(F.col("c").alias("v"), F.col("to").alias("_t")), "v").groupBy("u").agg(F.min("_t").alias("_m"))
        new = materialize(low.join(near, F.col("c") == F.col("u")).select("c", F.least("to", "_m").alias("to"), (F.col("_m") < F.col("to")).alias("moved")), "low")
        low = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return materialize(label.join(low, F.col("label") == F.col("c"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def verify_spanning_tree(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: whether `tree` is a tree over the graph's nodes with the least weight (its edges are not looked up)."""
    def nodes(x):
        return x.select(F.col("src").alias("node")).union(x.select("dst")).distinct()

    same = nodes(edges).exceptAll(nodes(tree)).isEmpty() and nodes(tree).exceptAll(nodes(edges)).isEmpty()
    least = minimum_spanning_forest(edges).agg(F.sum("weight").alias("least"))
    weight = tree.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg(F.min("weight").alias("w")).agg(F.sum("w").alias("weight"))
    return is_tree(tree, nodes(tree)).crossJoin(least).crossJoin(weight).select("is_tree", "weight", "least", (F.lit(same) & F.col("is_tree") & (F.col("weight") == F.col("least"))).alias("ok"))


def depth_first_path(edges: DataFrame, start, end) -> list | None:
    """The lexicographically first simple path, or None: at each step the least next node that still reaches the end."""
    path = [start]
    while path[-1] != end:
        left = edges.where(~F.col("src").isin(path[:-1]) & ~F.col("dst").isin(path))
        back = left.where(F.col("src") != path[-1]).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        ends = reach(back, edges.sparkSession.range(1).select(F.lit(end).alias("node")))
        nxt = left.where(F.col("src") == path[-1]).join(ends, F.col("dst") == F.col("node")).agg(F.min("dst")).first()[0]
        if nxt is None:
            return None
        path.append(nxt)
    return path
