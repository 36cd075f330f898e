"""Metrics of predictions, as aggregates over long tables.

Score metrics take any extra grouping columns `by`, so that the null distributions of
hypothesis tests are one query over all repetitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _entropy_rows(posteriors: DataFrame, by: list[str]) -> DataFrame:
    p = F.col("p")
    return posteriors.groupBy(*by, "row_id").agg(F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("h"))


def conditional_entropy(posteriors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean entropy of the rows' class posteriors, in nats."""
    by = by or []
    return _entropy_rows(posteriors, by).groupBy(*by).agg(F.avg("h").alias("cond_entropy"))


def mutual_information(posteriors: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """H(Y) of the labels less the conditional entropy of the posteriors."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all_n"))))
    h = total.agg(F.sum(-(F.col("n") / F.col("all_n")) * F.ln(F.col("n") / F.col("all_n"))).alias("hy"))
    return h.crossJoin(conditional_entropy(posteriors)).select((F.col("hy") - F.col("cond_entropy")).alias("mi"))


def roc_points(scored: DataFrame, by: list[str] | None = None, score: str = "score", positive: str = "y") -> DataFrame:
    """(by, score, tp, fp, P, N): counts at or above each distinct score. Scores are summed
    up first, so the window holds distinct values only."""
    from ..functions.prefix import running_sums

    by = by or []
    points = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(positive).cast("double")).alias("t"), F.sum(1.0 - F.col(positive).cast("double")).alias("f")
    ).withColumn("s", -F.col("score"))
    run = running_sums(points, by, "s", ["t", "f"])
    return run.select(*by, "score", "t", "f", F.col("left_t").alias("tp"), F.col("left_f").alias("fp"), F.col("total_t").alias("P"), F.col("total_f").alias("N"))


def sensitivity_at(scored: DataFrame, max_fpr: float = 0.02, by: list[str] | None = None) -> DataFrame:
    """Largest true positive rate over thresholds of false positive rate <= max_fpr, the
    empty prediction (0, 0) among them."""
    by = by or []
    ok = F.when(F.col("fp") / F.col("N") <= max_fpr, F.col("tp") / F.col("P")).otherwise(0.0)
    return roc_points(scored, by).groupBy(*by).agg(F.max(ok).alias("sensitivity"))


def auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve: each positive beats the negatives below it, and half of
    those with its score."""
    by = by or []
    won = F.col("t") * (F.col("N") - F.col("fp") + F.col("f") / 2)
    return roc_points(scored, by).groupBy(*by).agg((F.sum(won) / (F.max("P") * F.max("N"))).alias("auc"))


def partial_auc(scored: DataFrame, max_fpr: float, by: list[str] | None = None) -> DataFrame:
    """Trapezoid area of the ROC curve up to max_fpr (the last piece interpolated),
    scaled so that chance is 1/2 and a perfect score 1."""
    by = by or []
    r = roc_points(scored, by)
    x1, y1 = F.col("fp") / F.col("N"), F.col("tp") / F.col("P")
    x0, y0 = (F.col("fp") - F.col("f")) / F.col("N"), (F.col("tp") - F.col("t")) / F.col("P")
    end = F.least(x1, F.lit(max_fpr))
    y_end = F.when(x1 > x0, y0 + (y1 - y0) * (end - x0) / (x1 - x0)).otherwise(y1)
    area = F.when((x0 < max_fpr) & (x1 > x0), (end - x0) * (y0 + y_end) / 2).otherwise(0.0)
    least = max_fpr * max_fpr / 2
    return r.groupBy(*by).agg((0.5 * (1 + (F.sum(area) - least) / (max_fpr - least))).alias("partial_auc"))


def balanced_accuracy(pred: DataFrame, truth: str = "y", guess: str = "y_hat", by: list[str] | None = None) -> DataFrame:
    """Mean over classes of the share of their rows that are predicted right."""
    by = by or []
    per = pred.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("r"))
    return per.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))


def errors(pred: DataFrame, truth: str = "y", guess: str = "y_hat", by: list[str] | None = None) -> DataFrame:
    """Mean squared and mean absolute error."""
    by = by or []
    d = F.col(truth) - F.col(guess)
    return pred.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def hellinger(p: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Hellinger distance of two distributions given as columns over `key`."""
    gap = F.sqrt(F.col(a)) - F.sqrt(F.col(b))
    return p.agg((F.sqrt(F.sum(gap * gap)) / F.sqrt(F.lit(2.0))).alias("hellinger"))


def average_rank(rows: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Rank from 1 of each row's value, the mean rank for ties."""
    from ..functions.prefix import running_sums

    by = by or []
    counts = running_sums(rows.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("n")), by, value, ["n"])
    counts = counts.select(*by, value, (F.col("left_n") - (F.col("n") - 1) / 2).alias(out))
    return rows.join(counts, [*by, value])
