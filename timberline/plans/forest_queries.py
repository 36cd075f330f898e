"""Registered queries: routing, leaves, bags, honesty, posteriors and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import poisson_sql, poisson_steps, uniform, uniform_sql
from ..functions.special import average_path
from ..operators import bagging, posterior, routing
from ..sources.storage import checkpointed
from .fixtures import FOREST, LEAF, MATRIX, N_TREES, leaves, matrix, node_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _r(df, *columns, digits: int = 6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@register("route_tree", f"WITH {MATRIX}, {LEAF} SELECT row_id, tree, leaf FROM leaf")
def route_tree(spark, sf_dir):
    return leaves(matrix(spark, sf_dir)).select("row_id", "tree", "leaf")


@register("route_tree_join", f"WITH {MATRIX}, {LEAF} SELECT row_id, tree, leaf FROM leaf")
def route_tree_join(spark, sf_dir):
    """The same leaves by one join with the node table per level."""
    rows = matrix(spark, sf_dir).select("row_id", "features")
    return routing.route_join(rows, node_table(spark), 2).select("row_id", "tree", "leaf")


@register("leaf_values", f"WITH {MATRIX}, {LEAF} SELECT tree, leaf, cls, CAST(count(*) AS DOUBLE) AS weight FROM leaf GROUP BY ALL")
def leaf_values(spark, sf_dir):
    return routing.leaf_class_weights(leaves(matrix(spark, sf_dir)), "cls")


@register("leaf_means", f"WITH {MATRIX}, {LEAF} SELECT tree, leaf, round(avg(y), 4) AS mean, CAST(count(*) AS DOUBLE) AS weight FROM leaf GROUP BY ALL")
def leaf_means(spark, sf_dir):
    return _r(routing.leaf_means(leaves(matrix(spark, sf_dir)), "y"), "mean", digits=4)


@register("leaf_node_samples", f"""
WITH {MATRIX}, {LEAF} SELECT tree, leaf, len(list(row_id)) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM leaf GROUP BY ALL""")
def leaf_node_samples(spark, sf_dir):
    out = routing.leaf_members(leaves(matrix(spark, sf_dir)))
    return out.select("tree", "leaf", F.size("members").cast("bigint").alias("n"), F.element_at("members", 1).alias("first_row"),
                      F.element_at("members", -1).alias("last_row"))


def _paths_sql() -> str:
    parent = {(n["tree"], k): n["node"] for n in FOREST if n["left"] is not None for k in (n["left"], n["right"])}
    rows = []
    for n in FOREST:
        if n["left"] is None:
            path, k = [n["node"]], n["node"]
            while (n["tree"], k) in parent:
                k = parent[n["tree"], k]
                path.append(k)
            rows += [f"({n['tree']}, {n['node']}, {d}, {k})" for d, k in enumerate(reversed(path))]
    return f"paths(tree, leaf, depth, node) AS (VALUES {', '.join(rows)})"


@register("decision_path", f"""
WITH {MATRIX}, {LEAF}, {_paths_sql()}
SELECT row_id, tree, CAST(depth AS INTEGER) AS depth, CAST(paths.node AS INTEGER) AS node FROM leaf JOIN paths USING (tree, leaf)""")
def decision_path(spark, sf_dir):
    return routing.decision_path(leaves(matrix(spark, sf_dir)), node_table(spark))


_BAG = f"""bag AS (
  SELECT * FROM (SELECT m.*, CAST(tree AS INTEGER) AS tree,
                        CAST({poisson_sql(uniform_sql("bag", "row_id", "tree"), 1.6)} AS INTEGER) AS mult
                 FROM m, range(3) t(tree)) WHERE mult > 0)"""


@register("bootstrap_bag", f"WITH {MATRIX}, {_BAG} SELECT row_id, tree, mult FROM bag")
def bootstrap_bag(spark, sf_dir):
    return bagging.bootstrap(matrix(spark, sf_dir).select("row_id"), N_TREES, 1.6)


@register("subsample_bag", f"""
WITH {MATRIX} SELECT row_id, CAST(tree AS INTEGER) AS tree, 1 AS mult FROM m, range(3) t(tree) WHERE {uniform_sql("sub", "row_id", "tree")} < 0.3""")
def subsample_bag(spark, sf_dir):
    return bagging.subsample(matrix(spark, sf_dir).select("row_id"), N_TREES, 0.3)


@register("bootstrap_stratified", f"""
WITH {MATRIX}, sizes AS (SELECT cls, count(*) AS n FROM m GROUP BY cls),
numbered AS (SELECT row_id, cls, row_number() OVER (PARTITION BY cls ORDER BY {uniform_sql("stratnum", "row_id")}, row_id) - 1 AS place FROM m),
picks AS (SELECT cls, CAST(tree AS INTEGER) AS tree, CAST(floor({uniform_sql("strat", "cls", "tree", "place")} * n) AS BIGINT) AS k
          FROM numbered JOIN sizes USING (cls), range(3) t(tree))
SELECT n.row_id, p.cls, p.tree, CAST(count(*) AS BIGINT) AS mult FROM picks p JOIN numbered n ON p.cls = n.cls AND p.k = n.place GROUP BY ALL""")
def bootstrap_stratified(spark, sf_dir):
    rows = matrix(spark, sf_dir).select("row_id", "cls")
    return bagging.stratified_bootstrap(rows, N_TREES, "cls").select("row_id", "cls", "tree", "mult")


@register("oob_rows", f"""
WITH {MATRIX}, {_BAG} SELECT row_id, CAST(tree AS INTEGER) AS tree FROM m, range(3) t(tree)
WHERE NOT EXISTS (SELECT 1 FROM bag WHERE bag.row_id = m.row_id AND bag.tree = t.tree)""")
def oob_rows(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    return bagging.out_of_bag(rows, bagging.bootstrap(rows.select("row_id"), N_TREES, 1.6), N_TREES)


@register("class_weight_balanced", f"""
WITH {MATRIX}, {_BAG}, k AS (SELECT tree, cls, sum(mult) AS n_k FROM bag GROUP BY ALL)
SELECT tree, cls, round(sum(n_k) OVER (PARTITION BY tree) / (count(*) OVER (PARTITION BY tree) * n_k), 6) AS class_weight FROM k""")
def class_weight_balanced(spark, sf_dir):
    """Balanced class weights within each bag (balanced_subsample)."""
    bag = bagging.bootstrap(matrix(spark, sf_dir).select("row_id", "cls"), N_TREES, 1.6)
    out = bagging.balanced_class_weight(bag, "cls", ["tree"], "mult")
    return _r(out.select("tree", "cls", "class_weight").distinct(), "class_weight")


_ROLES = f"""roles AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY tree, cls ORDER BY {uniform_sql("honest", "row_id", "tree")}, row_id)
                      <= floor(count(*) OVER (PARTITION BY tree, cls) * 0.5::DOUBLE) THEN 'honest' ELSE 'structure' END AS role FROM bag)"""


def _roles(spark, sf_dir):
    return bagging.honest_partition(bagging.bootstrap(matrix(spark, sf_dir), N_TREES, 1.6), "cls")


@register("honest_partition", f"WITH {MATRIX}, {_BAG}, {_ROLES} SELECT row_id, tree, role FROM roles")
def honest_partition(spark, sf_dir):
    return _roles(spark, sf_dir).select("row_id", "tree", "role")


_HONEST = f"""honest AS (
  SELECT l.row_id, l.tree, l.leaf, l.cls, r.mult FROM leaf l JOIN roles r ON l.row_id = r.row_id AND l.tree = r.tree WHERE r.role = 'honest')"""


def _bagged_leaves(spark, sf_dir):
    leaf = leaves(matrix(spark, sf_dir)).select("row_id", "tree", "leaf", "cls")
    return bagging.multiplicity(leaf, 1.6)


def _honest(spark, sf_dir):
    """The last honest row of each (tree, cls), and the class weights of honest leaves."""
    return bagging.honest_cut(_bagged_leaves(spark, sf_dir).filter("mult > 0"), ["tree", "cls"], 0.5, "honest", ["leaf"])


@register("leaf_values_honest", f"""
WITH {MATRIX}, {LEAF}, {_BAG}, {_ROLES}, {_HONEST} SELECT tree, leaf, cls, CAST(sum(mult) AS DOUBLE) AS weight FROM honest GROUP BY ALL""")
def leaf_values_honest(spark, sf_dir):
    return _values(spark, sf_dir)


#: Honest rows of part of the feature space only, so that some leaves stay empty.
_SPARSE_LEAF = "sparse AS (SELECT * FROM leaf WHERE x2 <= 18)"


def _sparse(leaf):
    return leaf.filter(F.col("x2") <= 18)


@register("honest_prune_leaves", f"""
WITH {MATRIX}, {LEAF}, {_SPARSE_LEAF}, {_paths_sql()},
below AS (SELECT p.tree, p.node, count(s.row_id) AS n FROM paths p LEFT JOIN sparse s ON p.tree = s.tree AND p.leaf = s.leaf GROUP BY ALL),
kids AS (SELECT DISTINCT a.tree, a.node, b.node AS kid FROM paths a JOIN paths b ON a.tree = b.tree AND a.leaf = b.leaf AND b.depth = a.depth + 1),
broken AS (SELECT DISTINCT k.tree, k.node FROM kids k JOIN below b ON k.tree = b.tree AND k.kid = b.node WHERE b.n = 0)
SELECT p.tree, p.leaf, arg_min(p.node, p.depth) AS kept
FROM paths p LEFT JOIN broken b ON p.tree = b.tree AND p.node = b.node WHERE b.node IS NOT NULL OR p.node = p.leaf GROUP BY p.tree, p.leaf""")
def honest_prune_leaves(spark, sf_dir):
    leaf = _sparse(leaves(matrix(spark, sf_dir)))
    counts = leaf.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return routing.honest_prune(counts, node_table(spark))


_POST = """total AS (SELECT tree, leaf, sum(weight) AS total FROM vals GROUP BY ALL),
post AS (SELECT l.row_id, l.tree, v.cls, v.weight / t.total AS p FROM leaf l JOIN vals v ON l.tree = v.tree AND l.leaf = v.leaf
         JOIN total t ON l.tree = t.tree AND l.leaf = t.leaf)"""
_VALS = f"vals AS (SELECT tree, leaf, cls, CAST(sum(mult) AS DOUBLE) AS weight FROM honest GROUP BY ALL)"


def _values(spark, sf_dir):
    return checkpointed(_honest(spark, sf_dir)[1].select("tree", "leaf", "cls", "weight"))


def _vectors(spark, sf_dir):
    """(row_id, cls, v): the leaves of each row as one array."""
    rows = matrix(spark, sf_dir)
    return rows.select("row_id", "cls", routing.leaf_vector(FOREST).alias("v"))


@register("empty_leaf_prior", f"""
WITH {MATRIX}, {LEAF}, {_SPARSE_LEAF}, vals AS (SELECT tree, leaf, cls, CAST(count(*) AS DOUBLE) AS weight FROM sparse GROUP BY ALL), {_POST},
prior AS (SELECT cls, count(*) / sum(count(*)) OVER () AS p FROM m GROUP BY cls)
SELECT row_id, tree, cls, round(p, 6) AS p FROM post
UNION ALL SELECT l.row_id, l.tree, prior.cls, round(prior.p, 6) FROM leaf l, prior
WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.tree = l.tree AND v.leaf = l.leaf)""")
def empty_leaf_prior(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    leaf = leaves(rows)
    values = routing.leaf_class_weights(_sparse(leaf), "cls")
    return _r(posterior.with_prior(leaf, values, "cls", rows), "p")


@register("forest_posterior_average", f"""
WITH {MATRIX}, {LEAF}, {_BAG}, {_ROLES}, {_HONEST}, {_VALS}, {_POST}
SELECT row_id, cls, round(sum(p) / 3, 6) AS p FROM post GROUP BY ALL""")
def forest_posterior_average(spark, sf_dir):
    values = _values(spark, sf_dir)
    return _r(posterior.by_vector(_vectors(spark, sf_dir), lambda leaf: posterior.average(posterior.per_tree(leaf, values, "cls"), "cls")), "p")


@register("forest_posterior_kernel", f"""
WITH {MATRIX}, {LEAF}, {_BAG}, {_ROLES}, {_HONEST}, {_VALS},
pooled AS (SELECT l.row_id, v.cls, sum(v.weight) AS w FROM leaf l JOIN vals v ON l.tree = v.tree AND l.leaf = v.leaf GROUP BY ALL)
SELECT row_id, cls, round(w / sum(w) OVER (PARTITION BY row_id), 6) AS p FROM pooled""")
def forest_posterior_kernel(spark, sf_dir):
    values = _values(spark, sf_dir)
    return _r(posterior.by_vector(_vectors(spark, sf_dir), lambda leaf: posterior.kernel(leaf, values, "cls")), "p")


@register("posterior_per_tree_oob", f"""
WITH {MATRIX.replace("m AS (", "m AS MATERIALIZED (", 1)}, {LEAF.replace("leaf AS (", "leaf AS MATERIALIZED (", 1)},
{_BAG.replace("bag AS (", "bag AS MATERIALIZED (", 1)}, {_ROLES}, {_HONEST}, {_VALS.replace("vals AS (", "vals AS MATERIALIZED (", 1)}, {_POST}
SELECT post.row_id, post.tree, post.cls, round(post.p, 6) AS p FROM post ANTI JOIN bag ON bag.row_id = post.row_id AND bag.tree = post.tree""")
def posterior_per_tree_oob(spark, sf_dir):
    out = _bagged_leaves(spark, sf_dir).filter("mult = 0")
    return _r(posterior.per_tree(out, _values(spark, sf_dir), "cls"), "p")


@register("honest_decision_function", f"""
WITH {MATRIX}, {LEAF}, {_BAG}, {_ROLES}, {_HONEST}, {_VALS}, {_POST}
SELECT h.row_id, p.cls, round(sum(p.p) / count(DISTINCT h.tree), 6) AS p, count(DISTINCT h.tree) AS trees
FROM (SELECT row_id, tree FROM honest) h JOIN post p ON h.row_id = p.row_id AND h.tree = p.tree GROUP BY ALL""")
def honest_decision_function(spark, sf_dir):
    """Posteriors of each row over the trees that hold it as an honest row."""
    cut, values = _honest(spark, sf_dir)
    values = checkpointed(values)
    # a row's class has one cut per tree; its leaves in other trees than the honest ones go
    cuts = F.broadcast(cut.filter("_cu is not null").groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("tree", F.struct("_cu", "_cid").alias("c")))).alias("_c")))
    rows = _vectors(spark, sf_dir).join(cuts, "cls")
    in_bag = lambda t: uniform("bag", "row_id", t) >= poisson_steps(1.6)[0]
    held = lambda x: F.struct(uniform("honest", "row_id", x["tree"]).alias("_cu"), F.col("row_id").alias("_cid")) <= F.try_element_at("_c", x["tree"])
    rows = rows.withColumn("v", bagging.once(F.filter("v", lambda x: F.coalesce(in_bag(x["tree"]) & held(x), F.lit(False)))))

    def find(leaf):
        own = posterior.per_tree(leaf, values, "cls")
        return own.groupBy("row_id", "cls").agg(F.sum("p").alias("s"), F.count_distinct("tree").alias("trees")).withColumn("p", F.col("s") / F.col("trees")).drop("s")

    return _r(posterior.by_vector(rows, find).select("row_id", "cls", "p", "trees"), "p")


@register("quantile_predict", f"""
WITH {MATRIX}, {LEAF.replace("leaf AS (", "leaf AS MATERIALIZED (", 1)},
spots AS (
  SELECT row_id, max(CASE WHEN tree = 0 THEN leaf END) AS a, max(CASE WHEN tree = 1 THEN leaf END) AS b, max(CASE WHEN tree = 2 THEN leaf END) AS c
  FROM leaf GROUP BY row_id),
combos AS (SELECT DISTINCT a, b, c FROM spots),
pooled AS (
  SELECT a, b, c, x1 FROM combos JOIN leaf ON tree = 0 AND leaf = a UNION ALL SELECT a, b, c, x1 FROM combos JOIN leaf ON tree = 1 AND leaf = b
  UNION ALL SELECT a, b, c, x1 FROM combos JOIN leaf ON tree = 2 AND leaf = c),
q AS (SELECT a, b, c, quantile_cont(x1, 0.05) AS q_0, quantile_cont(x1, 0.5) AS q_1, quantile_cont(x1, 0.95) AS q_2 FROM pooled GROUP BY a, b, c)
SELECT row_id, q_0, q_1, q_2 FROM spots JOIN q USING (a, b, c)""")
def quantile_predict(spark, sf_dir):
    """Quantiles of the training targets that share leaves, for every row."""
    leaf = leaves(matrix(spark, sf_dir))
    return posterior.quantiles(leaf, leaf, "x1", [0.05, 0.5, 0.95])


@register("feature_importance", "SELECT * FROM (VALUES " + ", ".join(
    f"({f}, round({v!r}::DOUBLE, 6))" for f, v in (lambda raw: [(k, x / sum(raw.values())) for k, x in raw.items()])(
        {k: sum(n["gain"] for n in FOREST if n["left"] is not None and k in n["proj_idx"]) for k in range(4)}).__iter__()
) + ") AS t(feature, importance)")
def feature_importance(spark, sf_dir):
    nodes = node_table(spark).filter("not is_leaf")
    return _r(posterior.feature_importance(nodes), "importance")


_DEPTHS = "depths(tree, leaf, depth, n) AS (VALUES " + ", ".join(
    f"({n['tree']}, {n['node']}, {1 if n['node'] in (1, 2) else 2}, {n['n']})" for n in FOREST if n["left"] is None
) + ")"
_C = "CASE WHEN n <= 1 THEN 0.0::DOUBLE WHEN n = 2 THEN 1.0::DOUBLE ELSE 2 * (ln(n - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * (n - 1.0::DOUBLE) / n END"


def _path_lengths(spark, sf_dir):
    depth = node_table(spark).filter("is_leaf").select(
        "tree", F.col("node").alias("leaf"), (F.size("path") - 1 + average_path(F.col("n"))).alias("length")
    )
    return leaves(matrix(spark, sf_dir)).select("row_id", "tree", "leaf").join(depth, ["tree", "leaf"])


@register("isolation_path_length", f"""
WITH {MATRIX}, {LEAF}, {_DEPTHS} SELECT row_id, round(avg(depth + {_C}), 6) AS path_length FROM leaf JOIN depths USING (tree, leaf) GROUP BY row_id""")
def isolation_path_length(spark, sf_dir):
    return _path_lengths(spark, sf_dir).groupBy("row_id").agg(F.round(F.avg("length"), 6).alias("path_length"))


@register("isolation_score", f"""
WITH {MATRIX}, {LEAF}, {_DEPTHS},
s AS (SELECT row_id, round(-power(2.0::DOUBLE, -avg(depth + {_C}) / (SELECT {_C} FROM (SELECT 100.0::DOUBLE AS n))), 6) AS score FROM leaf JOIN depths USING (tree, leaf) GROUP BY row_id)
SELECT row_id, score, CASE WHEN score < (SELECT quantile_cont(score, 0.1) FROM s) THEN -1 ELSE 1 END AS predicted FROM s""")
def isolation_score(spark, sf_dir):
    """Scores -2^(-mean path / c(n)), and the contamination quantile's verdict."""
    mean = _path_lengths(spark, sf_dir).groupBy("row_id").agg(F.avg("length").alias("p"))
    scored = mean.select("row_id", F.round(-F.pow(F.lit(2.0), -F.col("p") / average_path(F.lit(100.0))), 6).alias("score"))
    cut = scored.agg(F.percentile("score", F.lit(0.1)).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).select("row_id", "score", F.when(F.col("score") < F.col("cut"), -1).otherwise(1).alias("predicted"))


@register("cv_folds", f"""
WITH {MATRIX} SELECT row_id, CAST((row_number() OVER (PARTITION BY cls ORDER BY {uniform_sql("fold", "row_id")}, row_id) - 1) % 5 AS INTEGER) AS fold FROM m""")
def cv_folds(spark, sf_dir):
    return bagging.cv_folds(matrix(spark, sf_dir).select("row_id", "cls"), "cls", 5).select("row_id", "fold")


@register("permute_covariate", f"""
WITH {MATRIX}, a AS (SELECT row_id, x1, row_number() OVER (ORDER BY {uniform_sql("permown", "row_id")}, row_id) AS r FROM m),
b AS (SELECT x2, x3, row_number() OVER (ORDER BY {uniform_sql("perm", "row_id")}, row_id) AS r FROM m)
SELECT row_id, x1, x2, x3 FROM a JOIN b USING (r)""")
def permute_covariate(spark, sf_dir):
    return bagging.permuted(matrix(spark, sf_dir).select("row_id", "x1", "x2", "x3"), ["x2", "x3"])
