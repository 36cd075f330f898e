"""Running sums along an ordered column, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, by: list[str], order: str, values: list[str], buckets: int = 256, right: bool = False) -> DataFrame:
    """Adds left_<v> (sum of v up to and with the row), total_<v>, and next_<order> (the
    group's next larger value) to rows that are unique by (by, order). With `right` also
    right_<v>, the sum of what follows, added up from the group's end: the difference of
    total and left has the rounding of the whole sum, however little follows.

    Each group's range is cut into equal buckets; bucket sums are accumulated first,
    then rows within their bucket. A group of any size is so spread over its buckets.
    """
    if not by:
        return running_sums(df.withColumn("_all", F.lit(0)), ["_all"], order, values, buckets, right).drop("_all")
    span = df.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    rows = df.join(span, by)
    place = F.floor((F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)
    rows = rows.withColumn(
        "_bucket", F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    ).drop("_lo", "_hi")
    sums = rows.groupBy(*by, "_bucket").agg(F.min(order).alias("_first"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    w = Window.partitionBy(*by).orderBy("_bucket")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    after = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_bucket", F.lead("_first").over(w).alias("_next"),
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0.0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"total_{v}") for v in values],
        *[F.coalesce(F.sum(f"_s_{v}").over(after), F.lit(0.0)).alias(f"_e_{v}") for v in values if right],
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, [*by, "_bucket"])
    for v in values:
        rows = rows.withColumn(f"left_{v}", F.col(f"_o_{v}") + F.sum(v).over(upto))
    back = Window.partitionBy(*by, "_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    for v in values if right else []:
        rows = rows.withColumn(f"right_{v}", F.col(f"_e_{v}") + F.coalesce(F.sum(v).over(back), F.lit(0.0)))
    rows = rows.withColumn(f"next_{order}", F.coalesce(F.lead(order).over(inner), F.col("_next")))
    return rows.drop("_bucket", "_next", *[f"_{k}_{v}" for v in values for k in "oe"])


def draw_rank(df: DataFrame, by: list[str], draw, tie: str, out: str, buckets: int = 1024) -> DataFrame:
    """Adds the rank (from 1) of a row within `by` in the order of a uniform draw, and the
    group's size as <out>_n. Draws are cut into equal ranges whose counts place them, so
    a group of any size is spread over as many tasks."""
    rows = df.withColumn("_u", draw).withColumn("_b", F.least(F.floor(F.col("_u") * buckets), F.lit(buckets - 1)).cast("int"))
    sums = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_b", before.alias("_before"), F.sum("_n").over(over).alias(f"{out}_n"))
    inner = Window.partitionBy(*by, "_b").orderBy("_u", tie)
    ranked = rows.join(sums, [*by, "_b"]).withColumn(out, F.col("_before") + F.row_number().over(inner))
    return ranked.drop("_u", "_b", "_before")
