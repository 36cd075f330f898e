"""Tables and small fixed models that the registered queries share, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import content_id
from ..operators.routing import route_fixed
from ..sources.storage import table


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a matrix: row_id by content, features x1..x4, classes and targets."""
    rows = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    x2, x3 = F.col("l_extendedprice") / 1000.0, F.col("l_discount") * 100
    rows = rows.select(
        content_id("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents).alias("row_id"),
        F.col("l_quantity").alias("x1"), x2.alias("x2"), x3.alias("x3"), (F.col("l_tax") * 100).alias("x4"),
        F.col("l_returnflag").alias("cls"), F.col("l_linestatus").alias("node"), F.col("l_extendedprice").alias("y"),
        (2 * F.col("l_quantity") + x2 - 5 * x3 > 60).cast("int").alias("yb"),
    )
    return rows.withColumn("features", F.array("x1", "x2", "x3", "x4"))


MATRIX = """m AS (
  SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 15) AS BIGINT) AS row_id,
         l_quantity AS x1, l_extendedprice / 1000.0::DOUBLE AS x2, l_discount * 100 AS x3, l_tax * 100 AS x4,
         l_returnflag AS cls, l_linestatus AS node, l_extendedprice AS y,
         CASE WHEN 2 * l_quantity + l_extendedprice / 1000.0::DOUBLE - 5 * (l_discount * 100) > 60 THEN 1 ELSE 0 END AS yb
  FROM lineitem)"""


def _split(tree: int, node: int, idx: list[int], w: list[float], threshold: float, left: int, right: int, n: int, gain: float) -> dict:
    return {"tree": tree, "node": node, "proj_idx": idx, "proj_w": w, "threshold": threshold, "left": left, "right": right, "n": n, "gain": gain}


def _leaf(tree: int, node: int, n: int) -> dict:
    return {"tree": tree, "node": node, "left": None, "n": n}


#: A forest of three trees over x1..x4, two of them with oblique splits.
FOREST = [
    _split(0, 0, [0], [1.0], 25.5, 1, 2, 100, 6.0), _split(0, 1, [1], [1.0], 20.0, 3, 4, 60, 2.5), _split(0, 2, [2], [1.0], 4.5, 5, 6, 40, 1.5),
    _leaf(0, 3, 45), _leaf(0, 4, 15), _leaf(0, 5, 10), _leaf(0, 6, 30),
    _split(1, 0, [0, 1], [1.0, -1.0], 0.0, 1, 2, 100, 4.0), _leaf(1, 1, 70), _split(1, 2, [3], [1.0], 3.5, 3, 4, 30, 3.0),
    _leaf(1, 3, 12), _leaf(1, 4, 18),
    _split(2, 0, [2, 3], [1.0, 1.0], 8.5, 1, 2, 100, 5.0), _split(2, 1, [1], [1.0], 35.0, 3, 4, 55, 0.5),
    _split(2, 2, [0], [1.0], 10.5, 5, 6, 45, 2.0), _leaf(2, 3, 30), _leaf(2, 4, 25), _leaf(2, 5, 9), _leaf(2, 6, 36),
]
N_TREES = 3
#: Only the first tree, whose splits have one feature each.
AXIS_TREE = [n for n in FOREST if n["tree"] == 0]


def leaves(rows: DataFrame, nodes: list[dict] = FOREST) -> DataFrame:
    return route_fixed(rows, nodes)


LEAF = """leaf AS (
  SELECT m.*, CAST(tree AS INTEGER) AS tree, CAST(CASE tree
    WHEN 0 THEN CASE WHEN x1 <= 25.5 THEN CASE WHEN x2 <= 20 THEN 3 ELSE 4 END ELSE CASE WHEN x3 <= 4.5 THEN 5 ELSE 6 END END
    WHEN 1 THEN CASE WHEN x1 - x2 <= 0 THEN 1 ELSE CASE WHEN x4 <= 3.5 THEN 3 ELSE 4 END END
    ELSE CASE WHEN x3 + x4 <= 8.5 THEN CASE WHEN x2 <= 35 THEN 3 ELSE 4 END ELSE CASE WHEN x1 <= 10.5 THEN 5 ELSE 6 END END
    END AS INTEGER) AS leaf
  FROM m, range(3) AS t(tree))"""


def node_table(spark: SparkSession, nodes: list[dict] = FOREST) -> DataFrame:
    """The fixed model as a node table with paths from the root."""
    parent = {(n["tree"], k): n["node"] for n in nodes if n["left"] is not None for k in (n["left"], n["right"])}
    rows = []
    for n in nodes:
        path, k = [n["node"]], n["node"]
        while (n["tree"], k) in parent:
            k = parent[n["tree"], k]
            path.insert(0, k)
        inner = n["left"] is not None
        rows.append((n["tree"], n["node"], n["left"], n["right"] if inner else None, not inner, n.get("threshold"), n.get("proj_idx"),
                     n.get("proj_w"), False, float(n["n"]), n.get("gain"), path))
    return spark.createDataFrame(
        rows, "tree int, node int, left int, right int, is_leaf boolean, threshold double, proj_idx array<int>, proj_w array<double>,"
              " missing_left boolean, n double, gain double, path array<int>",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label"
    )


#: Five trees over embeddings: tree t asks for the signs of three components from 3 t on.
SIGN_TREES = 5
SIGN_FOREST = [
    _split(t, k, [3 * t + depth], [1.0], 0.0, 2 * k + 1, 2 * k + 2, 8 >> depth, 1.0)
    for t in range(SIGN_TREES)
    for depth in range(3)
    for k in range(2**depth - 1, 2 ** (depth + 1) - 1)
] + [_leaf(t, k, 1) for t in range(SIGN_TREES) for k in range(7, 15)]

SIGN_LEAF = """leaf AS (
  SELECT vec_id AS row_id, label, CAST(tree AS INTEGER) AS tree,
         CAST(7 + 4 * (embedding[3 * tree + 1] > 0)::INT + 2 * (embedding[3 * tree + 2] > 0)::INT
              + (embedding[3 * tree + 3] > 0)::INT AS INTEGER) AS leaf
  FROM embeddings, range(5) AS t(tree))"""


def sign_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_fixed(vectors(spark, sf_dir), SIGN_FOREST).drop("features")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, score, y): a score of documents by their length against quality labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.round(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)), 2).alias("score"), F.col("quality").alias("y")
    )


SCORES = """scores AS (
  SELECT d.doc_id AS row_id, round(least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE), 2) AS score, quality AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
