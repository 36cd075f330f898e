"""Forest hypothesis tests on posterior tables: null distributions and p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import digest
from . import metrics

#: Metrics of which more is better, and those of which less is.
POSITIVE = ("auc", "mi", "s@98", "balanced_accuracy")
NEGATIVE = ("mse", "mae", "cond_entropy")


def metric(scored: DataFrame, name: str, by: list[str] | None = None, max_fpr: float = 0.02) -> DataFrame:
    """(by, stat) of (row_id, score, y) with y in {0, 1} and score the posterior of 1."""
    by = by or []
    if name == "auc":
        return metrics.auc(scored, by).withColumnRenamed("auc", "stat")
    if name == "s@98":
        return metrics.sensitivity_at(scored, max_fpr, by).withColumnRenamed("sensitivity", "stat")
    if name in ("mse", "mae"):
        e = metrics.errors(scored.withColumn("y", F.col("y").cast("double")), "y", "score", by)
        return e.select(*by, F.col(name).alias("stat"))
    if name == "balanced_accuracy":
        hard = scored.withColumn("y_hat", (F.col("score") > 0.5).cast("int"))
        return metrics.balanced_accuracy(hard, "y", "y_hat", by).withColumnRenamed("balanced_accuracy", "stat")
    if name in ("mi", "cond_entropy"):
        h = lambda p: F.when((p > 0) & (p < 1), -p * F.ln(p) - (1 - p) * F.ln(1 - p)).otherwise(0.0)
        share = F.avg(F.col("y").cast("double"))
        cond = F.avg(h(F.col("score")))
        return scored.groupBy(*by).agg((h(share) - cond if name == "mi" else cond).alias("stat"))
    raise ValueError(f"unknown metric {name!r}")


def halves(trees: DataFrame, n_repeats: int, salt: str = "coleman") -> DataFrame:
    """(rep, tree, half): each repetition shuffles all trees by their draws and cuts them
    into two halves of equal size (the first the smaller of an odd number)."""
    from pyspark.sql import Window

    reps = trees.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(digest(salt, "tree", "rep"), "tree"))
    n = F.count(F.lit(1)).over(Window.partitionBy("rep"))
    return reps.select("rep", "tree", F.when(rank <= F.floor(n / 2), 0).otherwise(1).alias("half"))


def mean_scores(posteriors: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, row_id, score, y): mean of the trees that scored the row; others are absent."""
    by = by or []
    return posteriors.groupBy(*by, "row_id").agg(F.avg("p").alias("score")).join(labels, "row_id")


def coleman_null(posteriors: DataFrame, labels: DataFrame, n_repeats: int, name: str = "s@98", max_fpr: float = 0.02, salt: str = "coleman") -> DataFrame:
    """(rep, null_stat): difference of the metric between two random halves of the trees of
    both forests together. posteriors: (tree, row_id, p) out of bag, tree ids distinct
    over the forests; a missing row stands for "not scored". One plan over all repetitions."""
    parts = posteriors.join(halves(posteriors.select("tree").distinct(), n_repeats, salt), "tree")
    stats = metric(mean_scores(parts, labels, ["rep", "half"]), name, ["rep", "half"], max_fpr)
    first, second = (F.max(F.when(F.col("half") == h, F.col("stat"))) for h in (0, 1))
    return stats.groupBy("rep").agg((first - second).alias("null_stat"))


def coleman_test(observed: DataFrame, permuted: DataFrame, labels: DataFrame, n_repeats: int, name: str = "s@98", max_fpr: float = 0.02, salt: str = "coleman") -> DataFrame:
    """One row (observe_stat, permuted_stat, observe_test_stat, pvalue) from posteriors of a
    forest and of one fitted to permuted data. p = (1 + #null at least as extreme) / (1 +
    n_repeats), extreme by the metric's direction."""
    a = metric(mean_scores(observed, labels), name, max_fpr=max_fpr).withColumnRenamed("stat", "observe_stat")
    b = metric(mean_scores(permuted, labels), name, max_fpr=max_fpr).withColumnRenamed("stat", "permuted_stat")
    both = observed.select(F.col("tree") * 2, "row_id", "p").toDF("tree", "row_id", "p").unionByName(
        permuted.select(F.col("tree") * 2 + 1, "row_id", "p").toDF("tree", "row_id", "p")
    )
    null = coleman_null(both, labels, n_repeats, name, max_fpr, salt)
    top = a.crossJoin(b).withColumn("observe_test_stat", F.col("observe_stat") - F.col("permuted_stat"))
    sign = -1 if name in NEGATIVE else 1
    hit = (sign * F.col("null_stat") >= sign * F.col("observe_test_stat")).cast("int")
    joined = null.crossJoin(F.broadcast(top))
    return joined.groupBy("observe_stat", "permuted_stat", "observe_test_stat").agg(
        ((1 + F.sum(hit)) / F.lit(1.0 + n_repeats)).alias("pvalue")
    )


def permutation_pvalue(observed_stat: float, null_stats: list[float], name: str) -> float:
    sign = -1 if name in NEGATIVE else 1
    return (1 + sum(sign * x >= sign * observed_stat for x in null_stats)) / (1 + len(null_stats))
