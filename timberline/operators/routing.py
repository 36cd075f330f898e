"""Routing rows to leaves, and tables of leaf values.

A model is a table nodes(tree, node, left, right, is_leaf, threshold, proj_idx, proj_w,
missing_left, value, ...). Everything after routing works on leaf(row_id, tree, leaf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import goes_left, linear

ROOT = 0


def leaf_vector(nodes: list[dict], features: str = "features") -> Column:
    """A row's leaves in a small model given as plain dictionaries: an array of (tree, leaf)."""
    by_tree: dict[int, dict[int, dict]] = {}
    for n in nodes:
        by_tree.setdefault(n["tree"], {})[n["node"]] = n

    def walk(tree: dict[int, dict], k: int) -> Column:
        n = tree[k]
        if n.get("left") is None:
            return F.lit(k)
        z = linear(F.col(features), F.array(*[F.lit(i) for i in n["proj_idx"]]), F.array(*[F.lit(float(w)) for w in n["proj_w"]]))
        left = goes_left(z, F.lit(n["threshold"]), F.lit(bool(n.get("missing_left", False))))
        return F.when(left, walk(tree, n["left"])).otherwise(walk(tree, n["right"]))

    return F.array(*[F.struct(F.lit(t).alias("tree"), walk(own, ROOT).alias("leaf")) for t, own in sorted(by_tree.items())])


def route_fixed(rows: DataFrame, nodes: list[dict], features: str = "features") -> DataFrame:
    """Leaves of a small model given as plain dictionaries, as one CASE per tree: no join."""
    return rows.withColumn("_l", F.explode(leaf_vector(nodes, features))).select(*rows.columns, F.col("_l.tree").alias("tree"), F.col("_l.leaf").alias("leaf"))


def route_join(rows: DataFrame, nodes: DataFrame, max_depth: int, features: str = "features") -> DataFrame:
    """Leaves of a model of any size, by one join with the node table per level. Spark
    broadcasts the node table only while it is below its own size threshold."""
    trees = nodes.select("tree").distinct()
    at = rows.crossJoin(F.broadcast(trees)).withColumn("node", F.lit(ROOT))
    inner = nodes.filter("not is_leaf").select("tree", "node", "left", "right", "threshold", "proj_idx", "proj_w", "missing_left")
    for _ in range(max_depth):
        z = linear(F.col(features), F.col("proj_idx"), F.col("proj_w"))
        step = F.when(goes_left(z, F.col("threshold"), F.col("missing_left")), F.col("left")).otherwise(F.col("right"))
        at = at.join(inner, ["tree", "node"], "left").select(
            *rows.columns, "tree", F.when(F.col("threshold").isNull(), F.col("node")).otherwise(step).alias("node")
        )
    return at.withColumnRenamed("node", "leaf")


def leaf_class_weights(leaf: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(tree, leaf, label, weight): class weights of every leaf."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return leaf.groupBy("tree", "leaf", label).agg(F.sum(w).alias("weight"))


def leaf_means(leaf: DataFrame, target: str, weight: str | None = None) -> DataFrame:
    """(tree, leaf, mean, weight) for regression."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return leaf.groupBy("tree", "leaf").agg((F.sum(w * F.col(target)) / F.sum(w)).alias("mean"), F.sum(w).alias("weight"))


def leaf_members(leaf: DataFrame) -> DataFrame:
    """(tree, leaf, members): row ids by leaf, sorted."""
    return leaf.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("row_id")).alias("members"))


def decision_path(leaf: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_id, tree, node, depth): the nodes that each row passes. Paths are made once
    per leaf from the parents' column path, then joined."""
    paths = nodes.filter("is_leaf").select("tree", F.col("node").alias("leaf"), "path")
    return leaf.select("row_id", "tree", "leaf").join(paths, ["tree", "leaf"]).select(
        "row_id", "tree", F.posexplode("path").alias("depth", "node")
    )


def honest_prune(leaf_counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Surviving leaves after pruning by honest rows: (tree, leaf, kept).

    nodes has path (ancestors from the root, the node itself last); leaf_counts has
    (tree, leaf, n) of honest rows. A split with no honest row on one side becomes a
    leaf, so each leaf falls back to the child of its first ancestor that does.
    """
    counts = nodes.filter("is_leaf").select("tree", F.col("node").alias("leaf"), "path").join(leaf_counts, ["tree", "leaf"], "left")
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0)))
    below = counts.select("tree", F.explode("path").alias("node"), "n").groupBy("tree", "node").agg(F.sum("n").alias("n"))
    inner = nodes.filter("not is_leaf").select("tree", "node", "left", "right")
    l, r = (below.select("tree", F.col("node").alias(s), F.col("n").alias(f"n_{s}")) for s in ("left", "right"))
    broken = (
        inner.join(l, ["tree", "left"]).join(r, ["tree", "right"]).filter("n_left = 0 or n_right = 0").select("tree", "node")
    ).withColumn("broken", F.lit(True))
    steps = counts.select("tree", "leaf", F.posexplode("path").alias("depth", "node")).join(broken, ["tree", "node"], "left")
    first = F.min(F.when(F.col("broken") | (F.col("node") == F.col("leaf")), F.struct("depth", "node")))
    return steps.groupBy("tree", "leaf").agg(first.alias("k")).select("tree", "leaf", F.col("k.node").alias("kept"))
