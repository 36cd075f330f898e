"""Split search: the best cut of each projection, as sort, running sums and top-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.criteria import CRITERIA, Criterion
from ..functions.draws import uniform
from ..functions.prefix import running_sums

#: Values closer than this are one value.
FEATURE_THRESHOLD = 1e-7


def _sums(c: Criterion, z: Column, label: str | None, classes, target: str | None, weight: Column) -> dict[str, Column]:
    out = {"w": F.sum(weight)}
    if c.kind == "class":
        for i, k in enumerate(classes):
            out[f"c{i}"] = F.sum(F.when(F.col(label) == F.lit(k), weight).otherwise(F.lit(0.0)))
        return out
    v = F.col(target).cast("double") if c.kind == "target" else z
    return out | {"s": F.sum(weight * v), "q": F.sum(weight * v * v)}


def cut_table(
    rows: DataFrame, by: list[str], criterion: str, z: str = "z", label: str | None = None, classes=None,
    target: str | None = None, weight: str | None = None, min_leaf: int = 1, min_weight: float = 0.0,
) -> DataFrame:
    """Every admissible cut of each group: (by, threshold, score, n_left, n_right).

    Rows are summed by value first (partial sums before the shuffle), then accumulated
    in value order. The threshold is the midpoint of the neighbouring values, or the left
    one where the midpoint is not below the right one.
    """
    c = CRITERIA[criterion]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    need = _sums(c, F.col(z), label, classes, target, w)
    points = rows.groupBy(*by, z).agg(F.count(F.lit(1)).cast("double").alias("n"), *[v.alias(k) for k, v in need.items()])
    names = ["n", *need]
    if c.name == "fastbic":
        # variances: sums of the own side only, of distances to the group's end on that side, so
        # that the few values of a small side aren't lost in the rounding of large sums
        span = points.groupBy(*by).agg(F.min(z).alias("_from"), F.max(z).alias("_to"))
        gap = {"l": F.col(z) - F.col("_from"), "r": F.col("_to") - F.col(z)}
        sums = [(F.col("w") * (d if k == "s" else d * d)).alias(f"{k}{side}") for side, d in gap.items() for k in "sq"]
        points = points.join(span, by).select(*by, z, "n", "w", *sums)
        run = running_sums(points, by, z, ["n", "w", "sl", "ql", "sr", "qr"], right=True)
        left, right = ({k: F.col(f"{to}_{k}" if k in "nw" else f"{to}_{k}{to[0]}") for k in names} for to in ("left", "right"))
    else:
        run = running_sums(points, by, z, names)
        left = {k: F.col(f"left_{k}") for k in names}
        right = {k: F.col(f"total_{k}") - F.col(f"left_{k}") for k in names}
    after = F.col(f"next_{z}")
    middle = F.col(z) / 2 + after / 2
    use = lambda s: {k: v for k, v in s.items() if k != "n"}
    return (
        run.filter(after - F.col(z) > FEATURE_THRESHOLD)
        .filter((left["n"] >= min_leaf) & (right["n"] >= min_leaf) & (left["w"] >= min_weight) & (right["w"] >= min_weight))
        .select(
            *by, F.when((middle == after) | F.isnan(middle), F.col(z)).otherwise(middle).alias("threshold"),
            c.score(use(left), use(right)).alias("score"),
            left["n"].cast("bigint").alias("n_left"), right["n"].cast("bigint").alias("n_right"),
        )
    )


def top_cut(cuts: DataFrame, group: list[str], ties: list[str], digits: int | None = None) -> DataFrame:
    """The cut of the highest score per group; of equal ones the smallest (ties,
    threshold). digits rounds scores before they are compared."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    best = F.min(F.struct((-score).alias("_s"), *ties, "threshold", "n_left", "n_right"))
    return cuts.groupBy(*group).agg(best.alias("b")).select(
        *group, *[F.col(f"b.{t}").alias(t) for t in ties], "b.threshold", (-F.col("b._s")).alias("score"), "b.n_left", "b.n_right"
    )


def random_cuts(
    rows: DataFrame, by: list[str], criterion: str, salt: str, z: str = "z", label: str | None = None, classes=None,
    target: str | None = None, min_leaf: int = 1,
) -> DataFrame:
    """One uniform threshold between the least and the largest value of each group, and
    its score: one pass for the range, one for the sums on both sides."""
    c = CRITERIA[criterion]
    span = rows.groupBy(*by).agg(F.min(z).alias("lo"), F.max(z).alias("hi")).filter(F.col("hi") - F.col("lo") > FEATURE_THRESHOLD)
    draw = F.col("lo") + uniform(salt, *by) * (F.col("hi") - F.col("lo"))
    span = span.withColumn("threshold", F.when(draw >= F.col("hi"), F.col("lo")).otherwise(draw)).drop("lo", "hi")
    joined = rows.join(span, by)
    is_left = F.col(z) <= F.col("threshold")
    one = F.lit(1.0)
    aggs = []
    need = _sums(c, F.col(z), label, classes, target, one)
    for side, on in (("left", is_left), ("right", ~is_left)):
        part = F.when(on, one).otherwise(F.lit(0.0))
        aggs += [v.alias(f"{side}_{k}") for k, v in _sums(c, F.col(z), label, classes, target, part).items()]
    out = joined.groupBy(*by, "threshold").agg(*aggs)
    left, right = ({k: F.col(f"{s}_{k}") for k in need} for s in ("left", "right"))
    return out.filter((left["w"] >= min_leaf) & (right["w"] >= min_leaf)).select(
        *by, "threshold", c.score(left, right).alias("score"),
        left["w"].cast("bigint").alias("n_left"), right["w"].cast("bigint").alias("n_right"),
    )
