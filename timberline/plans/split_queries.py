"""Registered queries: split search and candidate projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.arrays import ravel, unravel
from ..functions.draws import uniform_sql
from ..functions.prefix import running_sums  # noqa: F401  (re-exported for notebooks)
from ..operators import projections as pr
from ..operators.splits import cut_table, random_cuts, top_cut
from ..sources.storage import long_cells, table
from .fixtures import MATRIX, matrix, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Four oblique projections of x1..x4.
PROJECTIONS = [[1.0, 0, 0, 0], [1.0, -1.0, 0, 0], [0, 1.0, -1.0, 0], [1.0, 0, -1.0, 1.0]]


def _projected(rows, weights=PROJECTIONS):
    values = [
        F.struct(F.lit(i).alias("proj"), F.round(sum((F.col(f"x{k + 1}") * w for k, w in enumerate(ws) if w), F.lit(0.0)), 6).alias("z"))
        for i, ws in enumerate(weights)
    ]
    return rows.withColumn("_p", F.explode(F.array(*values))).select(*rows.columns, "_p.proj", "_p.z").drop("features")


_Z = """z AS (
  SELECT m.*, CAST(p.proj AS INTEGER) AS proj, round(CASE p.proj WHEN 0 THEN 0.0::DOUBLE + x1 WHEN 1 THEN 0.0::DOUBLE + x1 + x2 * -1.0::DOUBLE
         WHEN 2 THEN 0.0::DOUBLE + x2 + x3 * -1.0::DOUBLE ELSE 0.0::DOUBLE + x1 + x3 * -1.0::DOUBLE + x4 END, 6) AS z
  FROM m, range(4) AS p(proj))"""


def _cuts_sql(sums: str, score: str, by: str = "proj", least: int = 1) -> str:
    """Cut search in SQL: sums by value, running sums, score, the best cut of each group.
    sums: expressions named a, b, ...; score uses l_a, r_a and so on, nl and nr."""
    names = [s.split(" AS ")[-1].strip() for s in sums.split(";")]
    parts = ", ".join(s.strip() for s in sums.split(";"))
    run = ", ".join(f"sum({n}) OVER w AS l_{n}, sum({n}) OVER (PARTITION BY {by}) - sum({n}) OVER w AS r_{n}" for n in names)
    return f"""
WITH {MATRIX}, {_Z},
pts AS (SELECT {by}, z, CAST(count(*) AS DOUBLE) AS n, {parts} FROM z GROUP BY {by}, z),
run AS (
  SELECT {by}, z, lead(z) OVER (PARTITION BY {by} ORDER BY z) AS nz, sum(n) OVER w AS nl,
         sum(n) OVER (PARTITION BY {by}) - sum(n) OVER w AS nr, {run}
  FROM pts WINDOW w AS (PARTITION BY {by} ORDER BY z ROWS UNBOUNDED PRECEDING)),
cuts AS (
  SELECT {by}, round(z / 2 + nz / 2, 6) AS threshold, {score} AS score, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right
  FROM run WHERE nz - z > 1e-7::DOUBLE AND nl >= {least} AND nr >= {least}),
best AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 4) DESC, threshold) AS k FROM cuts)
SELECT {by}, threshold, round(score, 4) AS score, n_left, n_right FROM best WHERE k = 1
"""


def _best(rows, criterion, by=("proj",), **options):
    cuts = cut_table(_projected(rows), list(by), criterion, **options)
    return top_cut(cuts, list(by), [], digits=4).withColumn("threshold", F.round("threshold", 6)).withColumn("score", F.round("score", 4))


_CLASS_SUMS = "; ".join(f"sum(CASE WHEN cls = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {n}" for k, n in zip("ANR", "abc"))
_CLASS = {"label": "cls", "classes": ["A", "N", "R"]}


@register("split_gini_oblique", _cuts_sql(_CLASS_SUMS, "(l_a*l_a + l_b*l_b + l_c*l_c)/nl + (r_a*r_a + r_b*r_b + r_c*r_c)/nr"))
def split_gini_oblique(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "gini", **_CLASS)


@register("split_per_node", _cuts_sql(_CLASS_SUMS, "(l_a*l_a + l_b*l_b + l_c*l_c)/nl + (r_a*r_a + r_b*r_b + r_c*r_c)/nr", "node, proj"))
def split_per_node(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "gini", by=("node", "proj"), **_CLASS)


def _xlx(x: str, n: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * ln({x} / {n}) ELSE 0.0::DOUBLE END"


@register("split_entropy_axis", _cuts_sql(_CLASS_SUMS, " + ".join(_xlx(f"{s}_{k}", f"n{s}") for s in "lr" for k in "abc")))
def split_entropy_axis(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "entropy", **_CLASS)


_TARGET = "sum(CAST(x4 AS DOUBLE)) AS s"


@register("split_mse_axis", _cuts_sql(_TARGET, "l_s*l_s/nl + r_s*r_s/nr"))
def split_mse_axis(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "squared_error", target="x4")


@register("split_friedman", _cuts_sql(_TARGET, "(l_s/nl - r_s/nr) * (l_s/nl - r_s/nr) * nl * nr / (nl + nr)"))
def split_friedman(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "friedman_mse", target="x4")


@register("split_poisson", _cuts_sql(_TARGET, f"{_xlx('l_s', 'nl')} + {_xlx('r_s', 'nr')}"))
def split_poisson(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "poisson", target="x4")


_VALUE = "sum(z) AS s; sum(z * z) AS q"


@register("split_twomeans", _cuts_sql(_VALUE, "l_s*l_s/nl + r_s*r_s/nr"))
def split_twomeans(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "twomeans")


def _bic_sql() -> str:
    var = {s: f"greatest(({s}_q - {s}_s*{s}_s/n{s})/n{s}, 0.0::DOUBLE)" for s in "lr"}
    pooled = f"((nl*{var['l']} + nr*{var['r']}) / (nl + nr))"
    cost = lambda s, v: f"(-2.0::DOUBLE * (n{s} * ln(n{s}/(nl+nr)) - 0.5::DOUBLE * n{s} * ln({2 * math.pi!r}::DOUBLE * {v} + 1e-7::DOUBLE)))"
    return f"-least({cost('l', var['l'])} + {cost('r', var['r'])}, {cost('l', pooled)} + {cost('r', pooled)})"


@register("split_fastbic", _cuts_sql(_VALUE, _bic_sql(), least=100))
def split_fastbic(spark, sf_dir):
    return _best(matrix(spark, sf_dir), "fastbic", min_leaf=100)


@register("split_random_threshold", f"""
WITH {MATRIX}, {_Z},
span AS (SELECT proj, min(z) AS lo, max(z) AS hi FROM z GROUP BY proj),
thr AS (SELECT proj, lo + {uniform_sql("extra", "proj")} * (hi - lo) AS t FROM span)
SELECT proj, round(t, 6) AS threshold,
       round(sum(power(lc, 2) / nl + power(rc, 2) / nr), 4) AS score, CAST(max(nl) AS BIGINT) AS n_left, CAST(max(nr) AS BIGINT) AS n_right
FROM (SELECT proj, t, cls, CAST(sum((z <= t)::INT) AS DOUBLE) AS lc, CAST(sum((z > t)::INT) AS DOUBLE) AS rc,
             sum(CAST(sum((z <= t)::INT) AS DOUBLE)) OVER (PARTITION BY proj) AS nl,
             sum(CAST(sum((z > t)::INT) AS DOUBLE)) OVER (PARTITION BY proj) AS nr
      FROM z JOIN thr USING (proj) GROUP BY proj, t, cls)
GROUP BY proj, t""")  # fmt: skip
def split_random_threshold(spark, sf_dir):
    out = random_cuts(_projected(matrix(spark, sf_dir)), ["proj"], "gini", "extra", **_CLASS)
    return out.withColumn("threshold", F.round("threshold", 6)).withColumn("score", F.round("score", 4))


# candidate projections of 6 (tree, node) pairs

_NODES_SQL = "nodes AS (SELECT CAST(a AS INTEGER) AS tree, CAST(b AS INTEGER) AS node FROM range(3) t(a), range(2) n(b))"


def _nodes(spark):
    return spark.range(6).select((F.col("id") / 2).cast("int").alias("tree"), (F.col("id") % 2).cast("int").alias("node"))


@register("proj_axis", f"""
WITH {_NODES_SQL},
cells AS (SELECT tree, node, CAST(f AS INTEGER) AS feature FROM nodes, range(64) x(f)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {uniform_sql("axis", "tree", "node", "feature")}, feature) - 1 AS k FROM cells)
SELECT tree, node, CAST(k AS INTEGER) AS proj, feature, 1.0::DOUBLE AS weight FROM ranked WHERE k < 8""")  # fmt: skip
def proj_axis(spark, sf_dir):
    return pr.axis_candidates(_nodes(spark), 64, pr.resolve_max_features("sqrt", 64))


@register("proj_sparse_random", f"""
WITH {_NODES_SQL},
cells AS (SELECT tree, node, CAST(c AS INTEGER) AS cell FROM nodes, range({8 * 64}) x(c)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {uniform_sql("sparse", "tree", "node", "cell")}, cell) AS k FROM cells)
SELECT tree, node, CAST(cell // 64 AS INTEGER) AS proj, CAST(cell % 64 AS INTEGER) AS feature,
       CASE WHEN {uniform_sql("sparsesign", "tree", "node", "cell")} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM ranked WHERE k <= 12""")  # fmt: skip
def proj_sparse_random(spark, sf_dir):
    return pr.sparse_candidates(_nodes(spark), 64, 8, pr.resolve_feature_combinations(None, 64))


def _patch_sql(wrap: bool) -> str:
    size = [f"(2 + CAST(floor({uniform_sql(f'patchsize{d}', 'tree', 'node', 'proj')} * 3) AS BIGINT))" for d in (0, 1)]
    if wrap:
        at = [f"(CAST(floor({uniform_sql(f'patchat{d}', 'tree', 'node', 'proj')} * (8 + n{d} - 1)) AS BIGINT) - (n{d} - 1))" for d in (0, 1)]
    else:
        at = [f"CAST(floor({uniform_sql(f'patchat{d}', 'tree', 'node', 'proj')} * (8 - n{d} + 1)) AS BIGINT)" for d in (0, 1)]
    return f"""
WITH {_NODES_SQL},
rows AS (SELECT tree, node, CAST(p AS INTEGER) AS proj FROM nodes, range(4) x(p)),
sized AS (SELECT *, {size[0]} AS n0, {size[1]} AS n1 FROM rows),
placed AS (SELECT *, {at[0]} AS a0, {at[1]} AS a1 FROM sized),
cells AS (SELECT tree, node, proj, CAST(i * 8 + j AS INTEGER) AS feature FROM placed, range(8) r(i), range(8) c(j)
          WHERE i >= a0 AND i < a0 + n0 AND j >= a1 AND j < a1 + n1)"""


def _patches(spark, boundary=None):
    dims, low, high = pr.check_patch((8, 8), (2, 2), (4, 4), 64)
    return pr.patch_candidates(_nodes(spark), 4, dims, low, high, boundary)


@register("proj_patch_8x8", _patch_sql(False) + """
SELECT tree, node, proj, vec_id AS row_id, round(sum(embedding[feature + 1]::DOUBLE), 6) AS z
FROM cells, embeddings GROUP BY ALL""")  # fmt: skip
def proj_patch_8x8(spark, sf_dir):
    out = pr.project(long_cells(vectors(spark, sf_dir)), _patches(spark))
    return out.withColumn("z", F.round("z", 6))


@register("proj_patch_wrap", _patch_sql(True) + " SELECT tree, node, proj, feature, 1.0::DOUBLE AS weight FROM cells")
def proj_patch_wrap(spark, sf_dir):
    return _patches(spark, "wrap")


@register("proj_patch_weighted", _patch_sql(False) + """
SELECT tree, node, proj, vec_id AS row_id,
       round(sum(embedding[feature + 1]::DOUBLE) / sum(1 + abs(embedding[feature + 1]::DOUBLE)), 6) AS z
FROM cells, embeddings GROUP BY ALL""")  # fmt: skip
def proj_patch_weighted(spark, sf_dir):
    """Patch sums divided by the sums of per-row feature weights (here 1 + |x|)."""
    cells = long_cells(vectors(spark, sf_dir)).join(_patches(spark), "feature")
    z = F.sum("x") / F.sum(1 + F.abs("x"))
    return cells.groupBy("tree", "node", "proj", "row_id").agg(F.round(z, 6).alias("z"))


def _view_sql(keep: str) -> str:
    return f"""
WITH {_NODES_SQL},
cells AS (SELECT tree, node, CAST(f AS INTEGER) AS feature, CASE WHEN f >= 48 THEN 2 WHEN f >= 32 THEN 1 ELSE 0 END AS view FROM nodes, range(64) x(f)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree, node, view ORDER BY {uniform_sql("view", "tree", "node", "feature")}, feature) AS rank FROM cells),
{keep}"""


@register("proj_multiview", _view_sql("""
dealt AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY rank, view) - 1 AS k FROM ranked)
SELECT tree, node, CAST(k AS INTEGER) AS proj, feature, 1.0::DOUBLE AS weight FROM dealt WHERE k < 10"""))  # fmt: skip
def proj_multiview(spark, sf_dir):
    return pr.view_candidates(_nodes(spark), [32, 48, 64], 10)


@register("proj_multiview_mtry", _view_sql("""
kept AS (SELECT * FROM ranked WHERE rank <= CASE view WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 4 END)
SELECT tree, node, CAST(row_number() OVER (PARTITION BY tree, node ORDER BY rank, view) - 1 AS INTEGER) AS proj, feature, 1.0::DOUBLE AS weight FROM kept"""))  # fmt: skip
def proj_multiview_mtry(spark, sf_dir):
    ends = [32, 48, 64]
    return pr.view_candidates(_nodes(spark), ends, pr.resolve_view_features("sqrt", pr.view_sizes(ends)))


@register("ravel_unravel", """
SELECT CAST(i AS BIGINT) AS flat, CAST(i // 30 AS BIGINT) AS a, CAST((i // 10) % 3 AS BIGINT) AS b, CAST(i % 10 AS BIGINT) AS c, CAST(i AS BIGINT) AS back
FROM range(60) t(i)""")  # fmt: skip
def ravel_unravel(spark, sf_dir):
    dims = [2, 3, 10]
    parts = unravel(F.col("id"), dims)
    rows = spark.range(60).select(F.col("id").alias("flat"), *[p.cast("bigint").alias(n) for p, n in zip(parts, "abc")])
    return rows.withColumn("back", ravel([F.col("a"), F.col("b"), F.col("c")], dims))


__all__ = ["QUERIES", "SQL", "register", "table"]
