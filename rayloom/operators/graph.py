"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, kept


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node that is reached, for every node.

    Rounds of smallest-neighbour labels and pointer jumping until nothing changes: each halves
    the way to the root at least. Labels are aggregated before they are shuffled.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both)
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("r"), F.col("component").alias("rr"))
        now = kept(step.join(up, step["c"] == up["r"], "left").select("node", F.least("c", F.coalesce("rr", "c")).alias("component"), "was"))
        discard(labels)
        labels = now.select("node", "component")
        if now.where("component <> was").isEmpty():
            discard(both)
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def connectivity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, components (lone nodes count), size of the largest, nodes outside it."""
    labels = nodes.select("node").join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    s = sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), (F.sum("n") - F.max("n")).alias("outside"))
    return s.crossJoin(edges.agg(F.count("*").alias("n_edges"))).select("n_edges", "n_components", "largest", "outside")


def best_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The `k` heaviest edges of each node; edges (a, b, n)."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # edges are made once
    both = edges.select(F.explode(ends).alias("e"), "n").select("e.a", "e.b", "n")
    return both.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), F.asc("b")))).where(F.col("place") <= k)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The heaviest spanning forest of edges (a, b, n) by Boruvka's rounds: every component picks
    its heaviest edge outwards (ties by ids, so no cycles), and the picked edges join components."""
    e = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    labels, tree = kept(nodes.select("node", F.col("node").alias("c"))), None
    while True:
        x, y = (labels.select(F.col("node").alias(i), F.col("c").alias(f"c{i}")) for i in "ab")
        cross = kept(e.join(x, "a").join(y, "b").where("ca <> cb"))
        if cross.isEmpty():
            return tree if tree is not None else e.limit(0)
        ends = cross.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct(F.col("n"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y")).alias("s"))
        best = ends.groupBy("c").agg(F.max("s").alias("s")).select((-F.col("s.x")).alias("a"), (-F.col("s.y")).alias("b"), F.col("s.n").alias("n")).distinct()
        best = kept(best)
        tree = best if tree is None else kept(tree.unionByName(best))
        joined = connected_components(best.join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        labels = kept(labels.join(joined.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("c")))
