"""Candidate projections of split search, drawn per (tree, node) by portable draws.

All draws return the long table (tree, node, proj, feature, weight); drawing again gives
the same table. Parameter rules are plain functions on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform


def resolve_max_features(max_features, n_features: int) -> int:
    """sqrt, log2, a share, a number, or None for all; one at least."""
    if max_features is None:
        return n_features
    if max_features == "sqrt":
        return max(1, int(math.sqrt(n_features)))
    if max_features == "log2":
        return max(1, int(math.log2(n_features)))
    if isinstance(max_features, str):
        raise ValueError(f"unknown max_features {max_features!r}")
    if isinstance(max_features, float):
        return max(1, int(max_features * n_features))
    return int(max_features)


def resolve_feature_combinations(feature_combinations, n_features: int) -> float:
    """Mean number of features in a projection: min(n_features, 1.5) by default."""
    if feature_combinations is None:
        return min(n_features, 1.5)
    if feature_combinations > n_features:
        raise RuntimeError(f"feature_combinations {feature_combinations} exceeds the {n_features} features")
    return feature_combinations


def view_sizes(ends: list[int]) -> list[int]:
    if list(ends) != sorted(ends) or not ends:
        raise ValueError("feature_set_ends must increase")
    return [b - a for a, b in zip([0, *ends[:-1]], ends)]


def resolve_view_features(max_features, sizes: list[int]) -> list[int]:
    """Features taken from each view: of a share, sqrt or log2 the next larger number."""
    if isinstance(max_features, (list, tuple)):
        if len(max_features) != len(sizes):
            raise ValueError("one max_features per view is needed")
        return [resolve_view_features(m, [s])[0] for m, s in zip(max_features, sizes)]
    out = []
    for s in sizes:
        if max_features is None:
            k = s
        elif max_features == "sqrt":
            k = math.ceil(math.sqrt(s))
        elif max_features == "log2":
            k = math.ceil(math.log2(s)) if s > 1 else 1
        elif isinstance(max_features, float):
            k = math.ceil(max_features * s)
        else:
            k = int(max_features)
        if not 0 < k <= s:
            raise ValueError(f"max_features {max_features} doesn't fit a view of {s}")
        out.append(k)
    return out


def check_patch(data_dims, min_patch, max_patch, n_features: int) -> tuple[list[int], list[int], list[int]]:
    """Dimensions of the data and of patches: one row of all features by default."""
    dims = list(data_dims or (1, n_features))
    low = list(min_patch or [1] * len(dims))
    high = list(max_patch or dims)
    if math.prod(dims) != n_features:
        raise RuntimeError(f"data_dims {dims} don't hold {n_features} features")
    if not len(dims) == len(low) == len(high) or any(not 1 <= a <= b <= d for a, b, d in zip(low, high, dims)):
        raise RuntimeError("patch dimensions must be min <= max <= data")
    return dims, low, high


def axis_candidates(nodes: DataFrame, n_features: int, k: int, salt: str = "axis") -> DataFrame:
    """k features of each (tree, node) without replacement, by their draws' ranks."""
    cells = nodes.select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature"))
    w = Window.partitionBy("tree", "node").orderBy(uniform(salt, "tree", "node", "feature"), "feature")
    ranked = cells.withColumn("proj", F.row_number().over(w) - 1).filter(F.col("proj") < k)
    return ranked.select("tree", "node", "proj", "feature", F.lit(1.0).alias("weight"))


def sparse_candidates(
    nodes: DataFrame, n_features: int, max_features: int, combinations: float, salt: str = "sparse"
) -> DataFrame:
    """Sparse random projections: of the grid (max_features x n_features) max(int(
    max_features * combinations), 1) cells without replacement, each +1 or -1. Projections
    without a cell are absent."""
    nonzero = max(int(max_features * combinations), 1)
    cells = nodes.select(
        "tree", "node", F.explode(F.sequence(F.lit(0), F.lit(max_features * n_features - 1))).alias("cell")
    )
    w = Window.partitionBy("tree", "node").orderBy(uniform(salt, "tree", "node", "cell"), "cell")
    picked = cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= nonzero)
    return picked.select(
        "tree", "node", F.floor(F.col("cell") / n_features).cast("int").alias("proj"),
        F.pmod("cell", F.lit(n_features)).cast("int").alias("feature"),
        F.when(uniform(salt + "sign", "tree", "node", "cell") < 0.5, -1.0).otherwise(1.0).alias("weight"),
    )


def patch_candidates(
    nodes: DataFrame, k: int, dims: list[int], low: list[int], high: list[int], boundary: str | None = None,
    contiguous: list[bool] | None = None, salt: str = "patch",
) -> DataFrame:
    """k patches of each (tree, node): a size per dimension from low to high, a corner
    such that the patch fits (with boundary "wrap", one anywhere it touches the data,
    what hangs over is cut off), all its cells with weight 1. In a dimension that isn't
    contiguous the patch takes as many places, drawn without replacement."""
    rows = nodes.select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("proj"))
    cells = rows
    for d, size in enumerate(dims):
        n = low[d] + F.floor(uniform(f"{salt}size{d}", "tree", "node", "proj") * (high[d] - low[d] + 1))
        if boundary == "wrap":
            start = F.floor(uniform(f"{salt}at{d}", "tree", "node", "proj") * (size + n - 1)) - (n - 1)
            first, last = F.greatest(start, F.lit(0)), F.least(start + n, F.lit(size)) - 1
        else:
            first = F.floor(uniform(f"{salt}at{d}", "tree", "node", "proj") * (size - n + 1))
            last = first + n - 1
        if contiguous and not contiguous[d]:
            order = F.array_sort(
                F.transform(
                    F.sequence(F.lit(0), F.lit(size - 1)),
                    lambda i: F.struct(uniform(f"{salt}mix{d}", "tree", "node", "proj", i).alias("u"), i.alias("i")),
                )
            )
            places = F.slice(F.transform(order, lambda x: x["i"].cast("bigint")), F.lit(1), (last - first + 1).cast("int"))
        else:
            places = F.sequence(first, last)
        cells = cells.withColumn(f"_at{d}", F.explode(places))
    flat: Column = F.col("_at0")
    for d in range(1, len(dims)):
        flat = flat * dims[d] + F.col(f"_at{d}")
    return cells.select("tree", "node", "proj", flat.cast("int").alias("feature"), F.lit(1.0).alias("weight"))


def view_candidates(nodes: DataFrame, ends: list[int], take: list[int] | int, salt: str = "view") -> DataFrame:
    """Single features from views: `take` per view, or a total dealt round-robin, where
    views used up are passed over."""
    sizes = view_sizes(ends)
    n = ends[-1]
    of = F.lit(0)
    for e in ends[:-1]:
        of = of + F.when(F.col("feature") >= e, 1).otherwise(0)
    cells = nodes.select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("feature")).withColumn("view", of)
    w = Window.partitionBy("tree", "node", "view").orderBy(uniform(salt, "tree", "node", "feature"), "feature")
    ranked = cells.withColumn("rank", F.row_number().over(w))
    order = Window.partitionBy("tree", "node").orderBy("rank", "view")
    if isinstance(take, int):
        kept = ranked.withColumn("proj", F.row_number().over(order) - 1).filter(F.col("proj") < min(take, n))
    else:
        limit = F.element_at(F.array(*map(F.lit, take)), F.col("view") + 1)
        kept = ranked.filter(F.col("rank") <= limit).withColumn("proj", F.row_number().over(order) - 1)
    assert len(sizes) == len(ends)
    return kept.select("tree", "node", "proj", "feature", F.lit(1.0).alias("weight"))


def project(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Values of candidates: cells (row_id, feature, x, ...) in long form joined with
    candidates by feature. Returns (tree, node, proj, row_id, z)."""
    return (
        cells.join(candidates, "feature").groupBy("tree", "node", "proj", "row_id")
        .agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("z"))
    )
