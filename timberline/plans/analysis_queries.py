"""Registered queries: proximity, metrics, hypothesis tests, information, generators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.draws import normal_sql, uniform, uniform_sql
from ..operators import hypothesis, info, metrics, proximity
from ..sources import generators as gen
from ..sources.storage import table
from .fixtures import AXIS_TREE, MATRIX, SCORES, SIGN_LEAF, SIGN_TREES, matrix, scores, sign_leaves, vectors

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


# proximity

_SIM = """sim AS (SELECT a.row_id AS i, b.row_id AS j, count(*) / 5.0::DOUBLE AS sim FROM leaf a JOIN leaf b
  ON a.tree = b.tree AND a.leaf = b.leaf AND a.row_id < b.row_id GROUP BY ALL),
both_ways AS (SELECT i, j, 1 - sim AS dist FROM sim UNION ALL SELECT j, i, 1 - sim FROM sim)"""


def _sim(spark, sf_dir):
    return proximity.similarity(sign_leaves(spark, sf_dir), SIGN_TREES)


@register("similarity_pairs", f"WITH {SIGN_LEAF}, {_SIM} SELECT i, j, round(sim, 6) AS sim FROM sim")
def similarity_pairs(spark, sf_dir):
    return _r(_sim(spark, sf_dir), "sim")


@register("forest_knn", f"""
WITH {SIGN_LEAF}, {_SIM} SELECT i, j, round(dist, 6) AS dist, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY dist, j) AS INTEGER) AS rank FROM both_ways) WHERE rank <= 5""")
def forest_knn(spark, sf_dir):
    return _r(proximity.nearest_rows(sign_leaves(spark, sf_dir), SIGN_TREES, 5), "dist")


@register("forest_radius_neighbors", f"WITH {SIGN_LEAF}, {_SIM} SELECT i, j, round(dist, 6) AS dist FROM both_ways WHERE dist <= 0.65::DOUBLE")
def forest_radius_neighbors(spark, sf_dir):
    return _r(proximity.radius_neighbors(_sim(spark, sf_dir), 0.65), "dist")


@register("oob_proximity", f"""
WITH {SIGN_LEAF}, own AS (SELECT * FROM leaf WHERE {uniform_sql("oobsim", "row_id", "tree")} < 0.4)
SELECT a.row_id AS i, b.row_id AS j, round(avg((a.leaf = b.leaf)::INT), 6) AS sim FROM own a JOIN own b ON a.tree = b.tree AND a.row_id < b.row_id
GROUP BY ALL HAVING sum((a.leaf = b.leaf)::INT) > 0""")
def oob_proximity(spark, sf_dir):
    leaf = sign_leaves(spark, sf_dir)
    oob = leaf.filter(uniform("oobsim", "row_id", "tree") < 0.4)
    return proximity.oob_similarity(leaf, oob, digits=6)


@register("cluster_labels", f"""
WITH RECURSIVE {SIGN_LEAF}, {_SIM},
e AS (SELECT i, j FROM both_ways WHERE dist <= 0.25::DOUBLE),
reach(row_id, c) AS (SELECT DISTINCT row_id, row_id FROM leaf UNION SELECT r.row_id, e.j FROM reach r JOIN e ON r.c = e.i)
SELECT row_id, min(c) AS cluster FROM reach GROUP BY row_id""")
def cluster_labels(spark, sf_dir):
    """Single-linkage clusters of rows that share a leaf in four trees of five."""
    rows = vectors(spark, sf_dir).select("row_id")
    return proximity.components_above(_sim(spark, sf_dir), rows, 0.75)


@register("calinski_harabasz", """
WITH p AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
g AS (SELECT label, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS qa, sum(b * b) AS qb FROM p GROUP BY label),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(sa) AS sa, sum(sb) AS sb FROM g)
SELECT round(sum(g.n * (power(g.sa / g.n - t.sa / t.n, 2) + power(g.sb / g.n - t.sb / t.n, 2))) / (max(t.k) - 1)
       / (sum(qa - g.sa * g.sa / g.n + qb - g.sb * g.sb / g.n) / (max(t.n) - max(t.k))), 6) AS score FROM g, t""")
def calinski_harabasz(spark, sf_dir):
    points = vectors(spark, sf_dir).select("label", F.get("features", F.lit(0)).alias("a"), F.get("features", F.lit(1)).alias("b"))
    return _r(proximity.calinski_harabasz(points, ["a", "b"], "label"), "score")


@register("marginal_leaf_probability", f"""
WITH {MATRIX}, p AS (SELECT row_id, CASE WHEN x1 <= 25.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l, CASE WHEN x3 <= 4.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM m)
SELECT row_id, 0 AS tree, leaf, round(p, 6) AS p FROM (
  SELECT row_id, 3 AS leaf, l * 0.75::DOUBLE AS p FROM p UNION ALL SELECT row_id, 4, l * 0.25::DOUBLE FROM p
  UNION ALL SELECT row_id, 5, (1 - l) * r FROM p UNION ALL SELECT row_id, 6, (1 - l) * (1 - r) FROM p) WHERE p > 0""")
def marginal_leaf_probability(spark, sf_dir):
    """x2 is hidden: the split on it goes left with the training share 45 / 60."""
    return _r(proximity.marginal_leaf_probability(matrix(spark, sf_dir), AXIS_TREE, {1}), "p")


# metrics

_POST2 = "p2 AS (SELECT row_id, y, 1 AS class, score AS p FROM scores UNION ALL SELECT row_id, y, 0, 1 - score FROM scores)"
_H = "h AS (SELECT row_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0.0::DOUBLE END) AS h FROM p2 GROUP BY row_id)"


def _posteriors(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select("row_id", F.explode(F.array(F.col("score"), 1 - F.col("score"))).alias("p"))


@register("metric_cond_entropy", f"WITH {SCORES}, {_POST2}, {_H} SELECT round(avg(h), 6) AS cond_entropy FROM h")
def metric_cond_entropy(spark, sf_dir):
    return _r(metrics.conditional_entropy(_posteriors(spark, sf_dir)), "cond_entropy")


@register("metric_mi", f"""
WITH {SCORES}, {_POST2}, {_H}, c AS (SELECT count(*) / sum(count(*)) OVER () AS q FROM scores GROUP BY y)
SELECT round((SELECT sum(-q * ln(q)) FROM c) - (SELECT avg(h) FROM h), 6) AS mi""")
def metric_mi(spark, sf_dir):
    return _r(metrics.mutual_information(_posteriors(spark, sf_dir), scores(spark, sf_dir), "y"), "mi")


_ROC = """pts AS (SELECT score, CAST(sum(y) AS DOUBLE) AS t, CAST(sum(1 - y) AS DOUBLE) AS f FROM scores GROUP BY score),
roc AS (SELECT *, sum(t) OVER w AS tp, sum(f) OVER w AS fp, sum(t) OVER () AS p, sum(f) OVER () AS n FROM pts WINDOW w AS (ORDER BY score DESC))"""


@register("metric_sa98", f"WITH {SCORES}, {_ROC} SELECT round(max(CASE WHEN fp / n <= 0.02 THEN tp / p ELSE 0 END), 6) AS sensitivity FROM roc")
def metric_sa98(spark, sf_dir):
    return _r(metrics.sensitivity_at(scores(spark, sf_dir)), "sensitivity")


@register("metric_auc", f"""
WITH {SCORES} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc
FROM scores a, scores b WHERE a.y = 1 AND b.y = 0""")
def metric_auc(spark, sf_dir):
    return _r(metrics.auc(scores(spark, sf_dir)), "auc")


@register("metric_pauc", f"""
WITH {SCORES}, {_ROC}, seg AS (SELECT (fp - f) / n AS x0, fp / n AS x1, (tp - t) / p AS y0, tp / p AS y1 FROM roc),
cut AS (SELECT *, least(x1, 0.2::DOUBLE) AS e FROM seg WHERE x0 < 0.2 AND x1 > x0)
SELECT round(0.5::DOUBLE * (1 + (sum((e - x0) * (y0 + y0 + (y1 - y0) * (e - x0) / (x1 - x0)) / 2) - 0.02::DOUBLE) / (0.2::DOUBLE - 0.02::DOUBLE)), 6) AS partial_auc FROM cut""")
def metric_pauc(spark, sf_dir):
    return _r(metrics.partial_auc(scores(spark, sf_dir), 0.2), "partial_auc")


@register("metric_balanced_accuracy", f"WITH {SCORES} SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT avg((y = (score > 0.5)::INT)::INT) AS r FROM scores GROUP BY y)")
def metric_balanced_accuracy(spark, sf_dir):
    pred = scores(spark, sf_dir).withColumn("y_hat", (F.col("score") > 0.5).cast("int"))
    return _r(metrics.balanced_accuracy(pred), "balanced_accuracy")


@register("metric_mse_mae", f"WITH {SCORES} SELECT round(avg((y - score) * (y - score)), 6) AS mse, round(avg(abs(y - score)), 6) AS mae FROM scores")
def metric_mse_mae(spark, sf_dir):
    return _r(metrics.errors(scores(spark, sf_dir), "y", "score"), "mse", "mae")


@register("metric_hellinger", """
WITH a AS (SELECT o_orderpriority AS k, avg((o_orderstatus = 'F')::INT) AS s, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS f FROM orders GROUP BY 1),
p AS (SELECT f / sum(f) OVER () AS p, n / sum(n) OVER () AS q FROM a)
SELECT round(sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2.0::DOUBLE), 9) AS hellinger FROM p""")
def metric_hellinger(spark, sf_dir):
    from pyspark.sql import Window

    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("f")
    )
    w = Window.partitionBy(F.lit(0))
    p = a.select("k", (F.col("f") / F.sum("f").over(w)).alias("p"), (F.col("n") / F.sum("n").over(w)).alias("q"))
    return _r(metrics.hellinger(p, "k", "p", "q"), "hellinger", digits=9)


# hypothesis tests: two forests of 10 trees, each scoring some documents out of bag

_TREES_POST = f"""obs AS (SELECT row_id, y, CAST(t AS INTEGER) AS tree, 0.5::DOUBLE * score + 0.5::DOUBLE * {uniform_sql("o", "row_id", "t")} AS p
  FROM scores, range(10) x(t) WHERE {uniform_sql("oob", "row_id", "t")} < 0.4),
per AS (SELECT row_id, y, CAST(t AS INTEGER) AS tree, {uniform_sql("p", "row_id", "t")} AS p
  FROM scores, range(10) x(t) WHERE {uniform_sql("oobp", "row_id", "t")} < 0.4)"""


def _forests(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(9))))
    obs = s.filter(uniform("oob", "row_id", "tree") < 0.4).select("row_id", "tree", (0.5 * F.col("score") + 0.5 * uniform("o", "row_id", "tree")).alias("p"))
    per = s.filter(uniform("oobp", "row_id", "tree") < 0.4).select("row_id", "tree", uniform("p", "row_id", "tree").alias("p"))
    return obs, per, scores(spark, sf_dir).select("row_id", "y")


def _auc_sql(source: str, by: str) -> str:
    """Rank-sum AUC of (by, row_id, y, s)."""
    return f"""SELECT {by}, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS stat
  FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2.0::DOUBLE AS r FROM {source}) GROUP BY {by}"""


_NULL = f"""both_forests AS (SELECT row_id, y, tree * 2 AS tree, p FROM obs UNION ALL SELECT row_id, y, tree * 2 + 1, p FROM per),
shuffled AS (SELECT CAST(rep AS INTEGER) AS rep, tree,
  row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('_', CAST(tree AS VARCHAR), CAST(rep AS VARCHAR), 'coleman')), tree) AS k
  FROM (SELECT DISTINCT tree FROM both_forests), range(20) r(rep)),
parts AS (SELECT rep, CASE WHEN k <= 10 THEN 0 ELSE 1 END AS half, row_id, y, round(avg(p), 12) AS s FROM both_forests JOIN shuffled USING (tree) GROUP BY ALL),
stats AS ({_auc_sql("parts", "rep, half")}),
nulls AS (SELECT rep, max(CASE WHEN half = 0 THEN stat END) - max(CASE WHEN half = 1 THEN stat END) AS null_stat FROM stats GROUP BY rep)"""


@register("coleman_null", f"WITH {SCORES}, {_TREES_POST}, {_NULL} SELECT rep, round(null_stat, 6) AS null_stat FROM nulls")
def coleman_null(spark, sf_dir):
    obs, per, labels = _forests(spark, sf_dir)
    both = obs.withColumn("tree", F.col("tree") * 2).unionByName(per.withColumn("tree", F.col("tree") * 2 + 1))
    return _r(hypothesis.coleman_null(both, labels, 20, "auc"), "null_stat")


@register("coleman_pvalue", f"""
WITH {SCORES}, {_TREES_POST}, {_NULL},
mo AS (SELECT 0 AS g, row_id, y, avg(p) AS s FROM obs GROUP BY ALL), mp AS (SELECT 0 AS g, row_id, y, avg(p) AS s FROM per GROUP BY ALL),
a AS ({_auc_sql("mo", "g")}), b AS ({_auc_sql("mp", "g")})
SELECT round(a.stat, 6) AS observe_stat, round(b.stat, 6) AS permuted_stat, round(a.stat - b.stat, 6) AS observe_test_stat,
       round((1 + (SELECT count(*) FROM nulls WHERE null_stat >= a.stat - b.stat)) / 21.0::DOUBLE, 6) AS pvalue FROM a, b""")
def coleman_pvalue(spark, sf_dir):
    obs, per, labels = _forests(spark, sf_dir)
    return _r(hypothesis.coleman_test(obs, per, labels, 20, "auc"), "observe_stat", "permuted_stat", "observe_test_stat", "pvalue")


@register("stream_swap_rank", f"""
WITH {SCORES}, acc AS (SELECT CAST(t AS INTEGER) AS tree, avg((y = (0.5::DOUBLE * score + 0.5::DOUBLE * {uniform_sql("o", "row_id", "t")} > 0.5)::INT)::INT) AS a
  FROM scores, range(10) x(t) GROUP BY t)
SELECT tree, round(a, 6) AS accuracy, CAST(row_number() OVER (ORDER BY a, tree) AS INTEGER) AS rank FROM acc QUALIFY rank <= 2""")
def stream_swap_rank(spark, sf_dir):
    """The trees that a stream forest replaces: the least accurate on the new batch."""
    from ..streaming.forest import worst_trees

    s = scores(spark, sf_dir).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(9))))
    guess = (0.5 * F.col("score") + 0.5 * uniform("o", "row_id", "tree") > 0.5).cast("int")
    return _r(worst_trees(s.withColumn("y_hat", guess), 2), "accuracy")


# information and resampling

@register("rank_transform", f"WITH {MATRIX} SELECT row_id, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2.0::DOUBLE AS x1, rank() OVER (ORDER BY x3) + (count(*) OVER (PARTITION BY x3) - 1) / 2.0::DOUBLE AS x3 FROM m")
def rank_transform(spark, sf_dir):
    return info.rank_transform(matrix(spark, sf_dir).select("row_id", "x1", "x3"), ["x1", "x3"])


@register("uniform_transform", f"WITH {MATRIX} SELECT row_id, round(cume_dist() OVER (ORDER BY x2), 9) AS x2 FROM m")
def uniform_transform(spark, sf_dir):
    return _r(info.uniform_transform(matrix(spark, sf_dir).select("row_id", "x2"), ["x2"]), "x2", digits=9)


@register("standardize", f"WITH {MATRIX} SELECT row_id, round((x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER (), 6) AS x1, round((x4 - avg(x4) OVER ()) / stddev_pop(x4) OVER (), 6) AS x4 FROM m")
def standardize(spark, sf_dir):
    return _r(info.standardize(matrix(spark, sf_dir).select("row_id", "x1", "x4"), ["x1", "x4"]), "x1", "x4")


_POINTS = "pt AS (SELECT vec_id AS row_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)"


def _points(spark, sf_dir):
    return vectors(spark, sf_dir).select("row_id", *[F.get("features", F.lit(k)).alias(n) for k, n in enumerate("abc")])


_PAIRS = """pr AS (SELECT p.row_id AS i, q.row_id AS j, abs(p.a - q.a) AS da, abs(p.b - q.b) AS db, abs(p.c - q.c) AS dc FROM pt p JOIN pt q ON p.row_id <> q.row_id)"""


@register("ksg_neighbor_counts", f"""
WITH {_POINTS}, {_PAIRS}, d AS (SELECT *, greatest(da, db, dc) AS d, row_number() OVER (PARTITION BY i ORDER BY greatest(da, db, dc)) AS k FROM pr),
e AS (SELECT i, d AS eps FROM d WHERE k = 3)
SELECT i AS row_id, round(eps, 9) AS eps, CAST(sum((greatest(da, dc) < eps)::INT) AS BIGINT) AS nx, CAST(sum((greatest(db, dc) < eps)::INT) AS BIGINT) AS ny,
       CAST(sum((dc < eps)::INT) AS BIGINT) AS nz FROM pr JOIN e USING (i) GROUP BY i, eps""")
def ksg_neighbor_counts(spark, sf_dir):
    return _r(info.ksg_counts(_points(spark, sf_dir), ["a"], ["b"], ["c"], k=3), "eps", digits=9)


@register("conditional_resample", f"""
WITH {_POINTS}, {_PAIRS}, nn AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY greatest(da, db), j) AS rank FROM pr),
num AS (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql("resamplenum", "row_id")}, row_id) - 1 AS place FROM pt),
pick AS (SELECT place, CAST(floor({uniform_sql("resample", "place")} * (SELECT count(*) FROM pt)) AS BIGINT) AS at,
                CAST(floor({uniform_sql("resamplek", "place")} * 5) AS BIGINT) + 1 AS rank FROM num)
SELECT p.place, n.row_id, nn.j AS picked FROM pick p JOIN num n ON p.at = n.place JOIN nn ON nn.i = n.row_id AND nn.rank = p.rank""")
def conditional_resample(spark, sf_dir):
    return info.conditional_resample(_points(spark, sf_dir), ["a", "b"], 5)


@register("restricted_permutation")
def restricted_permutation(spark, sf_dir):
    near = info.nearest(_points(spark, sf_dir), ["a", "b"], 5)
    return info.restricted_permutation(near)


_MEANS, _COVS, _W = [[1.0, 1.0], [-1.0, -1.0]], [[[1.0, 0.5], [0.5, 1.0]], [[1.0, -0.5], [-0.5, 1.0]]], [0.5, 0.5]


def _density_sql(x: str, y: str, m, c) -> str:
    inv = np.linalg.inv(np.array(c))
    norm = 1 / (2 * math.pi * math.sqrt(np.linalg.det(np.array(c))))
    dx, dy = f"({x} - {m[0]!r}::DOUBLE)", f"({y} - {m[1]!r}::DOUBLE)"
    q = f"({float(inv[0, 0])!r}::DOUBLE * {dx} * {dx} + 2 * {float(inv[0, 1])!r}::DOUBLE * {dx} * {dy} + {float(inv[1, 1])!r}::DOUBLE * {dy} * {dy})"
    return f"({float(norm)!r}::DOUBLE * exp(-0.5::DOUBLE * {q}))"


@register("mi_grid_integral", f"""
WITH g AS (SELECT -10 + (i + 0.5::DOUBLE) * 0.1::DOUBLE AS x, -10 + (j + 0.5::DOUBLE) * 0.1::DOUBLE AS y FROM range(200) a(i), range(200) b(j)),
f AS (SELECT 0.5::DOUBLE * {_density_sql("x", "y", _MEANS[0], _COVS[0])} + 0.5::DOUBLE * {_density_sql("x", "y", _MEANS[1], _COVS[1])} AS f FROM g)
SELECT round(sum(CASE WHEN f > 0 THEN -f * ln(f) ELSE 0.0::DOUBLE END) * 0.01::DOUBLE - (1 + ln(2 * pi()) + 0.5::DOUBLE * ln(0.75::DOUBLE)), 6) AS mi FROM f""")
def mi_grid_integral(spark, sf_dir):
    return _r(info.grid_mutual_information(spark, _MEANS, _COVS, _W), "mi")


@register("mi_sampled", f"""
WITH {_POINTS}, d AS (SELECT 0.5::DOUBLE * {_density_sql("a * 4", "b * 4", _MEANS[0], _COVS[0])} AS p, 0.5::DOUBLE * {_density_sql("a * 4", "b * 4", _MEANS[1], _COVS[1])} AS q FROM pt)
SELECT round(ln(2.0::DOUBLE) + avg(p / (p + q) * ln(p / (p + q)) + q / (p + q) * ln(q / (p + q))), 6) AS mi FROM d""")
def mi_sampled(spark, sf_dir):
    rows = _points(spark, sf_dir).select((F.col("a") * 4).alias("a"), (F.col("b") * 4).alias("b"))
    return _r(info.sampled_mutual_information(rows, ["a", "b"], _MEANS, _COVS, _W), "mi")


# generators

def _flat(df, n: int, column: str = "features", digits: int = 6):
    return df.select("row_id", *[F.round(F.get(column, F.lit(k)), digits).alias(f"f{k}") for k in range(n)], *[c for c in ("label",) if c in df.columns])


def _n(salt: str, key: str = "row_id") -> str:
    return normal_sql(salt, key)


@register("sim_quadratic", "SELECT row_id, CAST((row_id >= 500) AS INTEGER) AS label, " + ", ".join(
    f"round(CASE WHEN row_id >= 500 THEN power({_n(f'q0_{k}', '(row_id % 500)')} * {math.exp(-0.0325 * (k + 24))!r}::DOUBLE, 2) "
    f"+ {_n(f'qe0_{k}', '(row_id % 500)')} ELSE {_n(f'q0_{k}', '(row_id % 500)')} END, 6) AS f{k}" for k in range(3)) + " FROM range(1000) t(row_id)")
def sim_quadratic(spark, sf_dir):
    return _flat(gen.make_quadratic_classification(spark, 500, 3, noise=True), 3)


@register("sim_trunk", "SELECT row_id, CAST((row_id >= 500) AS INTEGER) AS label, " + ", ".join(
    f"round({_n(f't0_{k}')} + CASE WHEN row_id >= 500 THEN {1 / math.sqrt(k + 1)!r}::DOUBLE ELSE 0.0::DOUBLE END, 6) AS f{k}" for k in range(4))
    + f", round({_n('t0noise4')}, 6) AS f4 FROM range(1000) t(row_id)")
def sim_trunk(spark, sf_dir):
    return _flat(gen.make_trunk_classification(spark, 1000, 5, 4), 5)


@register("sim_trunk_mixture", "SELECT row_id, CAST((row_id >= 500) AS INTEGER) AS label, " + ", ".join(
    f"round({_n(f'tm0_{k}')} + CASE WHEN row_id >= 500 AND {uniform_sql('tm0mix', 'row_id')} >= 0.3 THEN {1 / math.sqrt(k + 1)!r}::DOUBLE ELSE 0.0::DOUBLE END, 6) AS f{k}"
    for k in range(3)) + " FROM range(1000) t(row_id)")
def sim_trunk_mixture(spark, sf_dir):
    return _flat(gen.make_trunk_mixture_classification(spark, 1000, 3, 3, mix=0.3), 3)


def _wand_sql(parts) -> str:
    u, edge, mean, sd = uniform_sql("mw0mix", "row_id"), 0.0, "", ""
    for w, m, s in parts[:-1]:
        edge += w
        mean += f" WHEN {u} < {float(edge)!r}::DOUBLE THEN {float(m)!r}::DOUBLE"
        sd += f" WHEN {u} < {float(edge)!r}::DOUBLE THEN {float(s)!r}::DOUBLE"
    mean, sd = (f"(CASE{x} ELSE {float(parts[-1][k])!r}::DOUBLE END)" for x, k in ((mean, 1), (sd, 2)))
    cols = []
    for k in range(3):
        w = 1 / math.sqrt(k + 1)
        cols.append(f"round(CASE WHEN row_id >= 500 THEN {1 - w!r}::DOUBLE * {_n(f'mw0_{k}')} + {w!r}::DOUBLE * ({mean} + {sd} * {_n(f'mwg0_{k}')}) ELSE {_n(f'mw0_{k}')} END, 6) AS f{k}")
    return "SELECT row_id, CAST((row_id >= 500) AS INTEGER) AS label, " + ", ".join(cols) + " FROM range(1000) t(row_id)"


@register("sim_marron_wand", _wand_sql(gen.MARRON_WAND["trimodal"]))
def sim_marron_wand(spark, sf_dir):
    return _flat(gen.make_marron_wand_classification(spark, 1000, 3, 3, "trimodal"), 3)


@register("cov_banded", "SELECT i, j, CASE WHEN abs(i - j) <= 1 THEN power(0.3::DOUBLE, abs(i - j)) ELSE 0.0::DOUBLE END AS cov FROM range(6) a(i), range(6) b(j)")
def cov_banded(spark, sf_dir):
    return gen.covariance_table(spark, 6, 0.3)


@register("cov_autoregressive", "SELECT i, j, round(power(0.5::DOUBLE, abs(i - j)), 9) AS cov FROM range(6) a(i), range(6) b(j)")
def cov_autoregressive(spark, sf_dir):
    return _r(gen.covariance_table(spark, 6, 0.5, "ar"), "cov", digits=9)


@register("sim_helix", f"""
WITH p AS (SELECT row_id, 5 * pi() + 3 * pi() * {uniform_sql("hx0", "row_id")} AS p FROM range(1000) t(row_id))
SELECT row_id, round(p, 6) AS p, round(p * cos(p) / (8 * pi()), 6) AS x, round(p * sin(p) / (8 * pi()), 6) AS y, round(p / (8 * pi()), 6) AS z FROM p""")
def sim_helix(spark, sf_dir):
    return _r(gen.simulate_helix(spark, 1000), "p", "x", "y", "z")


@register("sim_sphere", f"""
WITH a AS (SELECT row_id, {uniform_sql("sa0", "row_id")} * 2 * pi() AS la, acos(1 - 2 * {uniform_sql("so0", "row_id")}) AS lo FROM range(1000) t(row_id))
SELECT row_id, round(la, 6) AS latitude, round(lo, 6) AS longitude, round(sin(lo) * cos(la), 6) AS x, round(sin(lo) * sin(la), 6) AS y, round(cos(lo), 6) AS z FROM a""")
def sim_sphere(spark, sf_dir):
    return _r(gen.simulate_sphere(spark, 1000), "latitude", "longitude", "x", "y", "z")


@register("sim_multivariate_gaussian", f"""
SELECT row_id, round({_n('mg0_0')} + 1.0::DOUBLE, 6) AS f0, round(0.5::DOUBLE * {_n('mg0_0')} + {math.sqrt(0.75)!r}::DOUBLE * {_n('mg0_1')} - 1.0::DOUBLE, 6) AS f1 FROM range(1000) t(row_id)""")
def sim_multivariate_gaussian(spark, sf_dir):
    return _flat(gen.simulate_multivariate_gaussian(spark, [1.0, -1.0], [[1.0, 0.5], [0.5, 1.0]], 1000), 2)


@register("sim_gaussian_mixture", f"""
WITH c AS (SELECT row_id, CASE WHEN {uniform_sql("gm0class", "row_id")} < 0.5 THEN 0 ELSE 1 END AS label FROM range(1000) t(row_id)),
z AS (SELECT row_id, label, CASE label WHEN 0 THEN {_n('gm0_0')} - 2 ELSE {_n('gm0_0')} + 2 END AS a, CASE label WHEN 0 THEN {_n('gm0_1')} ELSE {_n('gm0_1')} + 1 END AS b FROM c)
SELECT row_id, label, round(a, 6) AS a, round(b, 6) AS b, round(a * a, 6) AS a2, round(b * b, 6) AS b2 FROM z""")
def sim_gaussian_mixture(spark, sf_dir):
    eye = [[1.0, 0.0], [0.0, 1.0]]
    out = gen.make_gaussian_mixture(spark, [[-2.0, 0.0], [2.0, 1.0]], [eye, eye], 1000, transform="poly")
    get = lambda c, k: F.round(F.get(c, F.lit(k)), 6)
    return out.select("row_id", "label", get("view0", 0).alias("a"), get("view0", 1).alias("b"), get("view1", 0).alias("a2"), get("view1", 1).alias("b2"))


@register("sim_joint_factor_model")
def sim_joint_factor_model(spark, sf_dir):
    return gen.make_joint_factor_model(spark, 2, [4, 3], 500, joint_rank=2)
