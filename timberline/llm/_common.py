"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of
    ours where that setting is absent and all runs in one process (local tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="timberline-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/timberline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there,
    and an executor's loss costs no recomputation of what is written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more; on its own
    it does so when the driver's heap happens to fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Gives freed memory of a Python worker back, as the worker lives on for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name like wish that df doesn't have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in have:
        name += "_"
    return name


def running_total(
    df: DataFrame,
    value: str,
    bucket: Column,
    order: list,
    out: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Inclusive running sum of `value` within `by`, in the order (bucket, *order).

    Two levels, so that no task sees a whole group: sums by (by, bucket) are
    accumulated first, then each bucket's rows on their own. `bucket` must be an
    integer that never decreases along the order.
    """
    by = by or []
    b, off, tot = "_rt_bucket", "_rt_offset", "_rt_sum"
    rows = df.withColumn(b, bucket)
    sums = rows.groupBy(*by, b).agg(F.sum(value).alias(tot))
    spec = Window.orderBy(b) if not by else Window.partitionBy(*by).orderBy(b)
    before = sums.withColumn(
        off, F.coalesce(F.sum(tot).over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop(tot)
    keys = [*by, b]
    right = before.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], off)
    cond = None
    for i, k in enumerate(keys):
        c = rows[k].eqNullSafe(right[f"_r{i}"])
        cond = c if cond is None else cond & c
    joined = rows.join(right, cond).drop(*[f"_r{i}" for i in range(len(keys))])
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col(off) + F.sum(value).over(inner)).drop(b, off)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges (u, v), by alternating large-star
    and small-star steps until the stars no longer change.

    Returns (id, component_id), component_id being the smallest id reachable, for
    every id that has an edge to another id. Nulls and loops are ignored. Each
    step's edges are written to the shared folder; nothing comes to the driver
    but a count and a checksum.
    """
    e = (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = materialize(e, label)
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = materialize(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = materialize(small, label)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    top = e.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(top)
