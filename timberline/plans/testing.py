"""Forest hypothesis tests end to end: fit, score out of bag, resample, p-value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bagging, hypothesis
from .estimators import ForestEstimator, ForestModel


@dataclass
class ForestTestResult:
    """observe_test_stat, permuted_stat, observe_stat, pvalue, and the null distribution."""

    observe_test_stat: float
    permuted_stat: float
    observe_stat: float
    pvalue: float
    null_dist: DataFrame | list


def _binary(rows: DataFrame) -> tuple[list, DataFrame]:
    """The two classes, and (row_id, y) with y = 1 for the larger one."""
    classes = [r[0] for r in rows.select("label").distinct().orderBy("label").limit(3).collect()]
    if len(classes) != 2:
        raise RuntimeError("two classes are needed")
    return classes, rows.select("row_id", (F.col("label") == F.lit(classes[1])).cast("int").alias("y"))


def oob_scores(model: ForestModel, rows: DataFrame, positive, pairs: DataFrame | None = None) -> DataFrame:
    """(tree, row_id, p): posterior of the positive class for the pairs given, or for the
    rows out of each tree's bag. A scored row without that class has p = 0."""
    post = model.predict_proba_per_tree(rows, model.oob_pairs(rows) if pairs is None else pairs)
    p = F.sum(F.when(F.col("label") == F.lit(positive), F.col("p")).otherwise(0.0))
    return post.groupBy("tree", "row_id").agg(p.alias("p"))


def build_oob_forest(estimator: ForestEstimator, rows: DataFrame) -> tuple[ForestModel, DataFrame]:
    """A fitted forest, and its out-of-bag posteriors (tree, row_id, p)."""
    if not estimator.params["bootstrap"]:
        raise RuntimeError("the estimator needs bootstrap=True")
    classes, _ = _binary(rows)
    model = estimator.fit(rows)
    return model, oob_scores(model, rows, classes[1])


def build_coleman_forest(estimator: ForestEstimator, perm_estimator: ForestEstimator, rows: DataFrame, metric: str = "s@98",
                         n_repeats: int = 10_000, max_fpr: float = 0.02, seed: int = 0) -> ForestTestResult:
    """The statistic is the metric of the forest less that of one fitted to permuted data;
    the null exchanges trees between the two, n_repeats times, in two equal halves."""
    if metric not in hypothesis.POSITIVE + hypothesis.NEGATIVE:
        raise RuntimeError(f"unknown metric {metric!r}")
    classes, labels = _binary(rows)
    _, observed = build_oob_forest(estimator, rows)
    _, permuted = build_oob_forest(perm_estimator, rows)
    top = hypothesis.coleman_test(observed, permuted, labels, n_repeats, metric, max_fpr, f"coleman{seed}").first()
    both = observed.withColumn("tree", F.col("tree") * 2).unionByName(permuted.withColumn("tree", F.col("tree") * 2 + 1))
    null = hypothesis.coleman_null(both, labels, n_repeats, metric, max_fpr, f"coleman{seed}")
    return ForestTestResult(top["observe_test_stat"], top["permuted_stat"], top["observe_stat"], top["pvalue"], null)


def _stat(scores: DataFrame, labels: DataFrame, metric: str, max_fpr: float) -> float:
    return hypothesis.metric(hypothesis.mean_scores(scores, labels), metric, max_fpr=max_fpr).first()["stat"]


def build_permutation_forest(estimator: ForestEstimator, perm_estimator: ForestEstimator, rows: DataFrame, metric: str = "s@98",
                             n_repeats: int = 500, max_fpr: float = 0.02, seed: int = 0) -> ForestTestResult:
    """The null refits the permuted forest n_repeats times, each with its own seed."""
    _, labels = _binary(rows)
    _, observed = build_oob_forest(estimator, rows)
    stat = _stat(observed, labels, metric, max_fpr)
    null = []
    for r in range(n_repeats):
        again = type(perm_estimator)(**(perm_estimator.params | {"random_state": seed + r + 1}))
        null.append(_stat(build_oob_forest(again, rows)[1], labels, metric, max_fpr))
    p = hypothesis.permutation_pvalue(stat, null, metric)
    return ForestTestResult(stat - sum(null) / len(null), sum(null) / len(null), stat, p, null)


def build_cv_forest(estimator: ForestEstimator, rows: DataFrame, cv: int | None = 5, test_size: float = 0.2, seed: int = 0):
    """Per fold (model, per-tree posteriors of its test rows); with cv None one split, whose
    test rows are a stratified share of test_size."""
    classes, _ = _binary(rows)
    k = cv or max(2, round(1 / test_size))
    folds = bagging.cv_folds(rows, "label", k, f"cv{seed}")
    out = []
    for f in range(cv or 1):
        train, test = folds.filter(F.col("fold") != f).drop("fold"), folds.filter(F.col("fold") == f).drop("fold")
        model = estimator.fit(train)
        every = bagging.with_trees(test.select("row_id"), model.bag_spec["n_trees"])
        out.append((model, oob_scores(model, test, classes[1], every)))
    return out
