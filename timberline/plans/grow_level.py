"""Level-wise tree growth in DataFrames: all nodes of all trees advance together.

Each level is one plan: draw candidates per node, project, sum by value, find the best cut
per node, move rows. It scales with rows, not with what one worker can hold. Classifiers of few classes and
levels have their cuts found by passes over the rows (grow_wide), which write rows once only.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import cut_table, top_cut
from ..sources.storage import checkpointed, long_cells
from .estimators import MAX_WIDE_CLASSES
from .grow import CONVEX, MOST_LEVELS, TreeParams
from .grow_wide import WideGrower, written_rows

Candidates = Callable[[DataFrame], DataFrame]
#: Most trees of a bag whose weights become columns.
MAX_WIDE_TREES = 64


def grow_levels(
    bag: DataFrame | int, rows: DataFrame, candidates: Candidates, criterion: str, max_depth: int, label: str | None = None,
    classes: list | None = None, target: str | None = None, min_leaf: int = 1, digits: int | None = 9,
) -> DataFrame:
    """Node table (tree, node, left, right, is_leaf, threshold, proj_idx, proj_w,
    missing_left, n, depth, score) of trees grown to max_depth (at most 30).

    bag: (row_id, tree[, mult]), or the number of trees that have all rows; rows: (row_id, features, label or target); candidates: a
    function from active (tree, node) to the long table of projections. Nodes are
    numbered by heap: the children of k are 2k + 1 and 2k + 2. Each level's split nodes
    and row positions are checkpointed.
    """
    if not 0 <= max_depth <= 30:
        raise ValueError("max_depth must lie between 0 and 30")
    if label is not None and criterion in CONVEX and len(classes) <= MAX_WIDE_CLASSES and max_depth <= MOST_LEVELS:
        found = _by_passes(bag, rows, candidates, criterion, max_depth, label, classes, min_leaf, digits)
        if found is not None:
            return found
    if isinstance(bag, int):
        bag = rows.select("row_id", F.explode(F.array(*map(F.lit, range(bag)))).alias("tree"))
    value = label or target
    cells = long_cells(rows)
    weight = F.col("mult").cast("double") if "mult" in bag.columns else F.lit(1.0)
    at = checkpointed(
        bag.select("row_id", "tree", weight.alias("w")).join(rows.select("row_id", *([value] if value else [])), "row_id")
        .withColumn("node", F.lit(0))
    )
    done: list[DataFrame] = []
    for depth in range(max_depth + 1):
        sizes = at.groupBy("tree", "node").agg(F.sum("w").alias("n"))
        if depth == max_depth:
            done.append(_leaves(sizes, depth))
            break
        drawn = checkpointed(candidates(sizes.select("tree", "node")))
        z = (
            at.join(drawn, ["tree", "node"]).join(cells, ["row_id", "feature"])
            .groupBy("tree", "node", "proj", "row_id", "w", *([value] if value else []))
            .agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("z"))
        )
        cuts = cut_table(z, ["tree", "node", "proj"], criterion, label=label, classes=classes, target=target, weight="w", min_leaf=min_leaf)
        best = top_cut(_improving(cuts, at, criterion, label), ["tree", "node"], ["proj"], digits)
        parts = drawn.groupBy("tree", "node", "proj").agg(F.sort_array(F.collect_list(F.struct("feature", "weight"))).alias("p"))
        best = checkpointed(
            best.join(parts, ["tree", "node", "proj"]).select(
                "tree", "node", "threshold", "score", F.col("p.feature").alias("proj_idx"), F.col("p.weight").alias("proj_w"), "proj"
            )
        )
        done.append(_leaves(sizes.join(best.select("tree", "node"), ["tree", "node"], "left_anti"), depth))
        done.append(_inner(best.join(sizes, ["tree", "node"]), depth))
        chosen = z.join(best.select("tree", "node", "proj", "threshold"), ["tree", "node", "proj"])
        side = F.when(F.col("z") <= F.col("threshold"), 1).otherwise(2)
        at = checkpointed(chosen.select("row_id", "tree", "w", *([value] if value else []), (2 * F.col("node") + side).alias("node")))
        if at.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return checkpointed(out)


def _improving(cuts: DataFrame, at: DataFrame, criterion: str, label: str | None) -> DataFrame:
    """Cuts of nodes that aren't pure; pure nodes stay leaves."""
    if label is None:
        return cuts
    mixed = at.groupBy("tree", "node").agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a <> _b").select("tree", "node")
    return cuts.join(mixed, ["tree", "node"])


def _leaves(sizes: DataFrame, depth: int) -> DataFrame:
    none = F.lit(None)
    return sizes.select(
        "tree", "node", none.cast("int").alias("left"), none.cast("int").alias("right"), F.lit(True).alias("is_leaf"),
        none.cast("double").alias("threshold"), none.cast("array<int>").alias("proj_idx"), none.cast("array<double>").alias("proj_w"),
        F.lit(False).alias("missing_left"), F.col("n").cast("double").alias("n"), F.lit(depth).alias("depth"), none.cast("double").alias("score"),
    )


def _inner(best: DataFrame, depth: int) -> DataFrame:
    return best.select(
        "tree", "node", (2 * F.col("node") + 1).alias("left"), (2 * F.col("node") + 2).alias("right"), F.lit(False).alias("is_leaf"),
        "threshold", F.col("proj_idx").cast("array<int>"), F.col("proj_w").cast("array<double>"), F.lit(False).alias("missing_left"),
        F.col("n").cast("double"), F.lit(depth).alias("depth"), "score",
    )


class _LevelGrower(WideGrower):
    """Cuts as top_cut() takes them: by rounded scores, then by projection and threshold."""

    tie = 0.0


def _by_passes(bag, rows, candidates, criterion, max_depth, label, classes, min_leaf, digits) -> DataFrame | None:
    """The node table of grow_levels(), or None where rows hold what the passes don't take: nulls,
    NaN, features of unlike lengths or labels that aren't classes."""
    spark, head = rows.sparkSession, rows.select(F.size("features")).first()
    if head is None or head[0] < 1:
        return None
    n = head[0]
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    x = [F.get("features", F.lit(f)).cast("double") for f in range(n)]
    odd = F.coalesce(y < 0, F.lit(True)) | (F.size("features") != n)
    for v in x:
        odd = odd | v.isNull() | F.isnan(v)
    if not rows.filter(odd).isEmpty():
        return None
    flat = rows.select("row_id", *[v.alias(f"f{f}") for f, v in enumerate(x)], y.cast("double").alias("y"))
    if isinstance(bag, int):
        kind, weights = "int", {t: F.lit(1.0) for t in range(bag)}
    else:
        kind = bag.schema["tree"].dataType.simpleString()
        trees = sorted(r[0] for r in bag.filter("tree is not null").select("tree").distinct().limit(MAX_WIDE_TREES + 1).collect())
        if kind not in ("int", "bigint") or not 0 < len(trees) <= MAX_WIDE_TREES:
            return None
        mult = F.col("mult").cast("double") if "mult" in bag.columns else F.lit(1.0)
        own = bag.groupBy("row_id").agg(*[F.sum(F.when(F.col("tree") == t, mult).otherwise(0.0)).alias(f"u{t}") for t in trees])
        flat, weights = flat.join(own, "row_id"), {t: F.col(f"u{t}") for t in trees}
    written, many = written_rows(flat, n, weights)
    grower = _LevelGrower(written, {t: 0 for t in weights}, TreeParams(criterion=criterion, n_classes=len(classes), projection="oblique"), n, many)
    grower.digits = digits
    front = [grower._node(t, 1, 0, s) for t, s in grower.roots.items() if s[0] > 0]
    out = []
    for depth in range(max_depth + 1):
        mixed = [k for k in front if depth < max_depth and (k.sums[2:] > 0).sum() > 1]
        drawn: dict = {}
        if mixed:
            asked = spark.createDataFrame([(k.tree, k.path - 1) for k in mixed], f"tree {kind}, node int")
            for r in candidates(asked).select("tree", "node", "proj", "feature", "weight").collect():
                if 0 <= r["feature"] < n:
                    drawn.setdefault((r["tree"], r["node"] + 1), {}).setdefault(r["proj"], []).append((r["feature"], float(r["weight"])))
        for k in mixed:
            k.leaf, k.floor = max(min_leaf, 1), 0.0
            k.drawn = [tuple(np.array(c) for c in zip(*sorted(p))) for _, p in sorted(drawn.get((k.tree, k.path), {}).items())]
        cuts = {(k.tree, k.path): c for k, c in zip(mixed, grower._find(mixed))}
        kids = []
        for k in front:
            cut, node = cuts.get((k.tree, k.path)), k.path - 1
            if cut is None:
                out.append((k.tree, node, None, None, True, None, None, None, False, float(k.sums[1]), depth, None))
                continue
            score, idx, w, threshold, left = cut
            out.append((k.tree, node, 2 * node + 1, 2 * node + 2, False, float(threshold), [int(i) for i in idx], [float(v) for v in w], False,
                        float(k.sums[1]), depth, float(score)))
            a, b = (grower._node(k.tree, 2 * k.path + side, depth + 1, v) for side, v in ((0, left), (1, k.sums - left)))
            tree = grower.route[k.tree]
            tree.left[k.at], tree.right[k.at], tree.threshold[k.at], tree.proj_idx[k.at], tree.proj_w[k.at] = a.at, b.at, threshold, list(idx), list(w)
            kids += [a, b]
        front = kids
    schema = f"tree {kind}, node int, left int, right int, is_leaf boolean, threshold double, proj_idx array<int>, proj_w array<double>, missing_left boolean, n double, depth int, score double"
    return checkpointed(spark.createDataFrame(out, schema))
