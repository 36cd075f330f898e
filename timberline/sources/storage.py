"""Feature tables, checkpoints and model storage."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import content_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_table(df: DataFrame, columns: list[str], row_id=None, keep: list[str] | None = None) -> DataFrame:
    """(row_id, features ARRAY<FLOAT>, kept columns). Features are cast to float; a null
    feature is an error when rows are read, since null and NaN mean different things."""
    row_id = row_id if row_id is not None else content_id(*df.columns)
    checked = [
        F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null feature {c}")).cast("float")).otherwise(F.col(c).cast("float"))
        for c in columns
    ]
    return df.select(row_id.alias("row_id"), F.array(*checked).alias("features"), *(keep or []))


def long_cells(rows: DataFrame, features: str = "features") -> DataFrame:
    """(row_id, feature, x) of a feature table."""
    return rows.select("row_id", F.posexplode(features).alias("feature", "x"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset a new
    one is made, but only if all runs in one process: elsewhere that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="timberline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a reliable checkpoint in the cluster's folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def save_model(nodes: DataFrame, path: str, about: dict | None = None) -> None:
    """A model is its node table, and what tells how to read it."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark = nodes.sparkSession
    spark.createDataFrame([(json.dumps(about or {}),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes")


def load_about(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/about").first()[0])


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, below the checkpoint folder."""
    import uuid

    return f"{shared_folder(spark)}/timberline-{label}-{uuid.uuid4().hex}"
