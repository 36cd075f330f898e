"""Forest estimators over feature tables (row_id, features, label): fit gives a model
whose trees are a node table."""

from __future__ import annotations

import math
from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.prefix import draw_rank
from ..functions.special import average_path, np_average_path
from ..operators import bagging, posterior, proximity, routing
from ..sources.storage import checkpointed, load_about, load_model, save_model
from .grow import Grower, Tree, TreeParams, prune_empty, reachable, refill, suits
from .grow_wide import WideGrower, written_rows

NODE_SCHEMA = (
    "tree int, node int, left int, right int, parent int, depth int, is_leaf boolean, threshold double, proj_idx array<int>,"
    " proj_w array<double>, missing_left boolean, n double, w double, impurity double, gain double, value array<double>, path array<int>"
)
#: Models of more bytes are read by joins instead of being sent to every task; the results
#: are the same.
MAX_SENT_BYTES = 256 << 20
#: Trees over more rows are grown by passes over them, where grow_wide suits; the trees are the same.
MAX_BAG_ROWS = 1_000_000
#: Most classes of trees grown so, whose bounds try all corners of the classes' sums.
MAX_WIDE_CLASSES = 8
#: Most classes of a classifier.
MAX_CLASSES = 100_000


def _node_frame(tree_id: int, tree: Tree) -> pd.DataFrame:
    keep = reachable(tree)
    rows = []
    for k in keep:
        path, at = [k], k
        while tree.parent[at] >= 0:
            at = tree.parent[at]
            path.insert(0, at)
        leaf = tree.left[k] < 0
        rows.append((tree_id, k, None if leaf else tree.left[k], None if leaf else tree.right[k], tree.parent[k], tree.depth[k], leaf,
                     None if leaf else tree.threshold[k], tree.proj_idx[k], tree.proj_w[k], False, float(tree.n[k]), float(tree.w[k]),
                     float(tree.impurity[k]), 0.0 if leaf else float(tree.gain[k]), list(tree.value[k]), path))
    return pd.DataFrame(rows, columns=_NODE_COLUMNS)


_NODE_COLUMNS = ["tree", "node", "left", "right", "parent", "depth", "is_leaf", "threshold", "proj_idx", "proj_w", "missing_left", "n", "w",
                 "impurity", "gain", "value", "path"]


def _grow_group(pdf: pd.DataFrame, p: TreeParams, seed: int, honest: dict | None, permute: list[int] | None) -> pd.DataFrame:
    """One tree from its bag: rows (row_id, features, y, w, role)."""
    tree_id = int(pdf["tree"].iloc[0])
    pdf = pdf.sort_values("row_id")
    rng = np.random.default_rng([seed, tree_id])
    x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
    if np.isnan(x).any():
        raise ValueError("features hold NaN, which these trees don't take")
    y = pdf["y"].to_numpy()
    y = y.astype(np.int64) if p.task == "class" else y.astype(np.float64)
    w = pdf["w"].to_numpy(np.float64)
    if permute is not None:
        x[:, permute] = x[rng.permutation(len(x))][:, permute]
    grown = pdf["role"].to_numpy() != "honest"
    tree = Grower(x[grown], y[grown], w[grown], p, rng).grow()
    if honest is not None:
        own = ~grown
        refill(tree, x[own], y[own], w[own], p.n_classes)
        if honest["method"] == "prune":
            prune_empty(tree)
    return _node_frame(tree_id, tree)


class ForestModel:
    """A fitted forest: a node table and how its rows are to be read.

    Tables given to its methods need row_id and features. Results are long tables.
    """

    def __init__(self, nodes: DataFrame, task: str, classes: list, params: dict, bag: dict):
        self.nodes, self.task, self.classes, self.params, self.bag_spec = nodes, task, classes, params, bag
        self._sent = None

    # routing

    def _trees(self):
        """Node arrays by tree for use in tasks; None if the model is too large to send."""
        if self._sent is None:
            held = F.lit(96) + 8 * F.coalesce(F.size("value"), F.lit(0)) + 12 * F.greatest(F.coalesce(F.size("proj_idx"), F.lit(0)), F.lit(0))
            if (self.nodes.agg(F.sum(held)).first()[0] or 0) > MAX_SENT_BYTES:
                return None
            cols = ["tree", "node", "left", "right", "threshold", "proj_idx", "proj_w", "depth", "n", "value"]
            self._sent = {int(t): _Flat(g) for t, g in self.nodes.select(*cols).toPandas().groupby("tree")}
        return self._sent

    def apply(self, rows: DataFrame) -> DataFrame:
        """(row_id, tree, leaf)."""
        trees = self._trees()
        rows = rows.select("row_id", "features")
        if trees is None:
            depth = self.nodes.agg(F.max("depth")).first()[0]
            return routing.route_join(rows, self.nodes, depth).select("row_id", "tree", "leaf")

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                for t, flat in trees.items():
                    yield pd.DataFrame({"row_id": pdf["row_id"], "tree": np.int32(t), "leaf": flat.apply(x).astype(np.int32)})

        return rows.mapInPandas(run, "row_id long, tree int, leaf int")

    def leaf_values(self) -> DataFrame:
        """(tree, leaf, label, weight) of classification leaves; zero weights are absent."""
        names = F.array(*[F.lit(c) for c in self.classes])
        parts = self.nodes.filter("is_leaf").select("tree", F.col("node").alias("leaf"), F.posexplode("value").alias("k", "weight"))
        return parts.filter("weight > 0").select("tree", "leaf", F.get(names, F.col("k")).alias("label"), "weight")

    # predictions

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """(row_id, proba array in the order of classes). Leaves are pooled over trees and
        normalised once (kernel) or averaged; rows that no tree scores get the prior."""
        trees, k = self._trees(), len(self.classes)
        kernel = bool(self.params.get("kernel_method", False))
        prior = self.bag_spec.get("prior") or [1.0 / k] * k
        empty = self.params.get("honest_prior", "ignore")
        fill = prior if empty == "empirical" else [1.0 / k] * k if empty == "uniform" else None
        if trees is None:
            return self._joined_proba(rows, kernel, fill, prior)

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                total = np.zeros((len(x), k))
                for flat in trees.values():
                    v = flat.value[flat.apply(x)]
                    s = v.sum(1, keepdims=True)
                    if fill is not None:
                        v = np.where(s > 0, v, fill)
                        s = v.sum(1, keepdims=True)
                    total += v if kernel else np.divide(v, s, out=np.zeros_like(v), where=s > 0)
                s = total.sum(1, keepdims=True)
                p = np.where(s > 0, total / np.where(s > 0, s, 1), prior)
                yield pd.DataFrame({"row_id": pdf["row_id"], "proba": list(p)})

        return rows.select("row_id", "features").mapInPandas(run, "row_id long, proba array<double>")

    def _joined_proba(self, rows: DataFrame, kernel: bool, fill: list | None, prior: list) -> DataFrame:
        """predict_proba by joins, for models that aren't sent."""
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        longs = lambda v: F.array(*[F.lit(float(x)) for x in v])
        value = self.nodes.filter("is_leaf").select("tree", F.col("node").alias("leaf"), F.col("value").alias("v"))
        if fill is not None:
            value = value.withColumn("v", F.when(total(F.col("v")) > 0, F.col("v")).otherwise(longs(fill)))
        if not kernel:
            value = value.withColumn("s", total(F.col("v")))
            value = value.withColumn("v", F.transform("v", lambda x: F.when(F.col("s") > 0, x / F.col("s")).otherwise(0.0)))
        parts = self.apply(rows).join(value.select("tree", "leaf", "v"), ["tree", "leaf"]).select("row_id", F.posexplode("v").alias("k", "p"))
        parts = parts.groupBy("row_id", "k").agg(F.sum("p").alias("p"))
        per_row = parts.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("v"))
        per_row = per_row.withColumn("s", total(F.col("v")))
        return per_row.select("row_id", F.when(F.col("s") > 0, F.transform("v", lambda x: x / F.col("s"))).otherwise(longs(prior)).alias("proba"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """(row_id, prediction): the likeliest class, or the mean of the trees' values."""
        if self.task == "class":
            names = F.array(*[F.lit(c) for c in self.classes])
            at = F.array_position("proba", F.array_max("proba")).cast("int") - 1
            return self.predict_proba(rows).select("row_id", F.get(names, at).alias("prediction"))
        trees = self._trees()
        if trees is not None:

            def run(batches):
                for pdf in batches:
                    if len(pdf):
                        x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                        total = sum(flat.value[flat.apply(x), 0] for flat in trees.values())
                        yield pd.DataFrame({"row_id": pdf["row_id"], "prediction": total / len(trees)})

            return rows.select("row_id", "features").mapInPandas(run, "row_id long, prediction double")
        values = self.nodes.filter("is_leaf").select("tree", F.col("node").alias("leaf"), F.get("value", F.lit(0)).alias("v"))
        return self.apply(rows).join(values, ["tree", "leaf"]).groupBy("row_id").agg(F.avg("v").alias("prediction"))

    def predict_proba_per_tree(self, rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """(row_id, tree, label, p), of the given (row_id, tree) only if there are any."""
        post = posterior.per_tree(self.apply(rows), self.leaf_values(), "label")
        return post if pairs is None else posterior.restricted(post, pairs)

    def predict_quantiles(self, rows: DataFrame, train: DataFrame, target: str, q: list[float]) -> DataFrame:
        """Quantiles of the training targets that share leaves with each row."""
        return posterior.quantiles(self.apply(rows), self.apply(train).join(train.select("row_id", target), "row_id"), target, q)

    # bags

    def bag(self, rows: DataFrame) -> DataFrame:
        return _bag(rows, self.bag_spec)

    def oob_pairs(self, rows: DataFrame) -> DataFrame:
        """(row_id, tree) of training rows outside each tree's bag."""
        if not self.bag_spec["bootstrap"]:
            raise RuntimeError("out-of-bag rows need bootstrap=True")
        return bagging.out_of_bag(rows, self.bag(rows), self.bag_spec["n_trees"])

    def oob_proba(self, rows: DataFrame) -> DataFrame:
        """(row_id, label, p) averaged over the trees for which the row is out of bag."""
        return posterior.average(self.predict_proba_per_tree(rows, self.oob_pairs(rows)), "label")

    def honest_decision_function(self, rows: DataFrame) -> DataFrame:
        """(row_id, label, p) over the trees that hold the row as an honest one."""
        own = self.bag(rows).filter("role = 'honest'")
        return posterior.average(self.predict_proba_per_tree(rows, own), "label")

    # structure

    def similarity(self, rows: DataFrame) -> DataFrame:
        return proximity.similarity(self.apply(rows), self.bag_spec["n_trees"])

    def decision_path(self, rows: DataFrame) -> DataFrame:
        return routing.decision_path(self.apply(rows), self.nodes)

    def leaf_node_samples(self, rows: DataFrame) -> DataFrame:
        return routing.leaf_members(self.apply(rows))

    def feature_importances(self) -> DataFrame:
        return posterior.feature_importance(self.nodes.filter("not is_leaf"))

    def labels(self, rows: DataFrame, threshold: float = 0.5, clustering=None, n_clusters: int | None = None) -> DataFrame:
        """Clusters of rows by forest similarity: single linkage at a threshold or with at
        most n_clusters clusters, or what a function of (similarity pairs, rows) gives."""
        if not clustering and n_clusters is None and dict(rows.dtypes)["row_id"] in ("tinyint", "smallint", "int", "bigint"):
            return proximity.clusters_above(self.apply(rows), self.bag_spec["n_trees"], rows, threshold)
        sim = self.similarity(rows)
        if clustering:
            return clustering(sim, rows)
        if n_clusters is not None:
            return proximity.components_of(sim, rows, n_clusters, self.bag_spec["n_trees"])
        return proximity.components_above(sim, rows, threshold)

    def kneighbors(self, rows: DataFrame, n_neighbors: int = 5, asked: DataFrame | None = None) -> DataFrame:
        """(i, j, dist, rank): the n_neighbors nearest rows to each row, or to each `asked` one."""
        if asked is None:
            if dict(rows.dtypes)["row_id"] in ("tinyint", "smallint", "int", "bigint"):
                return proximity.nearest_rows(self.apply(rows), self.bag_spec["n_trees"], n_neighbors, rows)
            return proximity.k_neighbors(self.similarity(rows), n_neighbors, rows)
        sim = proximity.cross_similarity(self.apply(asked), self.apply(rows), self.bag_spec["n_trees"])
        return proximity.k_neighbors(sim, n_neighbors, rows, asked)

    def radius_neighbors(self, rows: DataFrame, radius=1.0) -> DataFrame:
        return proximity.radius_neighbors(self.similarity(rows), radius, rows)

    def save(self, path: str) -> None:
        """Writes all that load() needs: nodes, classes, parameters and the bags' rule."""
        params = dict(self.params)
        if isinstance(params.get("class_weight"), dict):
            params["class_weight"] = {"pairs": list(params["class_weight"].items())}
        save_model(self.nodes, path, {"task": self.task, "classes": self.classes, "params": params, "bag": self.bag_spec})

    def with_nodes(self, nodes: DataFrame) -> "ForestModel":
        return ForestModel(nodes, self.task, self.classes, self.params, self.bag_spec)


class _Flat:
    """One tree's arrays, for routing in tasks."""

    def __init__(self, g: pd.DataFrame):
        size = int(g["node"].max()) + 1
        node = g["node"].to_numpy()
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.left[node], self.right[node] = g["left"].fillna(-1), g["right"].fillna(-1)
        self.threshold = np.full(size, np.nan)
        self.threshold[node] = g["threshold"].astype(float)
        self.idx, self.w = [None] * size, [None] * size
        self.depth, self.n = np.zeros(size), np.zeros(size)
        self.depth[node], self.n[node] = g["depth"], g["n"]
        width = max(len(v) for v in g["value"])
        self.value = np.zeros((size, width))
        for k, i, w, v in zip(node, g["proj_idx"], g["proj_w"], g["value"]):
            self.idx[k], self.w[k] = np.asarray(i, np.int64), np.asarray(w, float)
            self.value[k, : len(v)] = v

    def apply(self, x: np.ndarray) -> np.ndarray:
        return Tree.apply(_Lists(self), x)


class _Lists:
    def __init__(self, f: _Flat):
        self.left, self.right, self.threshold, self.proj_idx, self.proj_w = f.left, f.right, f.threshold, f.idx, f.w


def _bag(rows: DataFrame, spec: dict) -> DataFrame:
    """Bags as the model was fitted: (row columns, tree, mult, role)."""
    salt, n = f"{spec['salt']}{spec['seed']}", spec["n_trees"]
    kind, size = spec["kind"], spec["max_samples"]
    if kind == "all":
        bag = bagging.with_trees(rows, n).withColumn("mult", F.lit(1))
    elif kind == "poisson":
        bag = bagging.bootstrap(rows, n, size, salt)
    elif kind == "stratified":
        bag = bagging.stratified_bootstrap(rows, n, "label", salt)
    else:  # exactly `size` rows without replacement
        ranked = draw_rank(bagging.with_trees(rows, n), ["tree"], uniform(salt, "row_id", "tree"), "row_id", "_k", 64)
        bag = ranked.filter(F.col("_k") <= int(size)).drop("_k", "_k_n").withColumn("mult", F.lit(1))
    if spec.get("honest_fraction"):
        return bagging.honest_partition(bag, "label" if spec.get("stratify") else None, spec["honest_fraction"], salt + "h")
    return bag.withColumn("role", F.lit("structure"))


_TREE_FIELDS = {f.name for f in fields(TreeParams)}


class ForestEstimator:
    """Base of the estimators. Parameters are those of DEFAULTS and of its parents; fit
    takes a table (row_id, features, label[, weight])."""

    DEFAULTS: dict = {
        "n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0,
        "max_leaf_nodes": None, "min_impurity_decrease": 0.0, "random_state": None, "bootstrap": True, "max_samples": None,
        "class_weight": None, "max_features": None, "feature_combinations": None, "criterion": "gini", "warm_start": False, "oob_score": False,
    }
    TREE: dict = {}

    def __init__(self, **params):
        known = self.defaults()
        unknown = set(params) - set(known)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        self.params = known | params

    @classmethod
    def defaults(cls) -> dict:
        out: dict = {}
        for c in reversed(cls.__mro__):
            out |= c.__dict__.get("DEFAULTS", {})
        return out

    @classmethod
    def tree_fixed(cls) -> dict:
        out: dict = {}
        for c in reversed(cls.__mro__):
            out |= c.__dict__.get("TREE", {})
        return out

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params) -> "ForestEstimator":
        self.__init__(**(self.params | params))
        return self

    def _tree_params(self, n_classes: int) -> TreeParams:
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in self.params.items() if k in _TREE_FIELDS}
        return replace(TreeParams(), **(own | self.tree_fixed() | {"n_classes": n_classes}))

    def _bag_spec(self, n_rows: int) -> dict:
        p = self.params
        size = p["max_samples"]
        share = 1.0 if size is None else size if isinstance(size, float) else size / n_rows
        kind = "poisson" if p["bootstrap"] else "all" if size is None else "exact"
        if p["bootstrap"] and p.get("stratify_bootstrap"):
            kind = "stratified"
        if kind == "exact":
            share = int(size * n_rows) if isinstance(size, float) else size
        return {"kind": kind, "max_samples": share, "n_trees": p["n_estimators"], "seed": p["random_state"] or 0, "salt": "bag",
                "bootstrap": p["bootstrap"], "honest_fraction": p.get("honest_fraction"), "stratify": p.get("stratify", False)}

    def fit(self, rows: DataFrame, previous: ForestModel | None = None, permute: list[int] | None = None) -> ForestModel:
        """Grows the forest. `previous` (with warm_start) keeps its trees and adds the
        missing ones; `permute` names features that each tree permutes in its bag."""
        task = self.tree_fixed().get("task", "class")
        head = rows.select(F.size("features")).first()
        if head is None:
            raise ValueError("no rows to fit")
        n_features = head[0]
        has = set(rows.columns)
        base = rows.select("row_id", F.col("features").cast("array<double>").alias("features"),
                           *(["label"] if "label" in has else []), *(["weight"] if "weight" in has else []))
        if "weight" in has:
            base = base.filter("weight > 0")
        classes: list = []
        spec = self._bag_spec(base.count() if isinstance(self.params["max_samples"], int) or not self.params["bootstrap"] else 1)
        if task == "class":
            counts = base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(MAX_CLASSES + 1).collect()
            if len(counts) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes")
            classes = [r["label"] for r in counts]
            spec["prior"] = [r["n"] / sum(c["n"] for c in counts) for r in counts]
        tree = self._tree_params(len(classes))
        tree.check(n_features)
        wide = suits(tree) and len(classes) <= MAX_WIDE_CLASSES and permute is None and spec["kind"] in ("all", "poisson")
        if wide and not (spec.get("honest_fraction") or self.params["class_weight"] or (previous is not None and self.params["warm_start"])):
            n_rows = sum(r["n"] for r in counts) if task == "class" else base.count()
            if n_rows > MAX_BAG_ROWS:
                return ForestModel(self._grown_wide(base, spec, tree, classes, n_features), task, classes, self.params, spec)
        bag = _bag(base, spec)
        if task == "class":
            names = F.array(*[F.lit(c) for c in classes])
            bag = bag.withColumn("y", (F.array_position(names, F.col("label")) - 1).cast("double"))
        else:
            bag = bag.withColumn("y", F.col("label").cast("double") if "label" in has else F.lit(0.0))
        w = F.col("mult").cast("double") * (F.col("weight") if "weight" in has else F.lit(1.0))
        weight = self.params["class_weight"]
        if weight and task == "class":
            by = ["tree"] if weight == "balanced_subsample" else None
            if isinstance(weight, dict):
                own = F.lit(1.0)
                for c, v in weight.items():
                    own = F.when(F.col("label") == F.lit(c), float(v)).otherwise(own)
                bag = bag.withColumn("class_weight", own)
            elif by:
                bag = bagging.balanced_class_weight(bag, "label", by, "mult")
            else:
                per_row = bagging.balanced_class_weight(base.select("row_id", "label"), "label").select("label", "class_weight").distinct()
                bag = bag.join(per_row, "label")
            w = w * F.col("class_weight")
        first = 0
        if previous is not None and self.params["warm_start"]:
            first = previous.bag_spec["n_trees"]
            if spec["n_trees"] < first:
                raise ValueError(f"n_estimators {spec['n_trees']} is below the {first} trees there are")
            bag = bag.filter(F.col("tree") >= first)
        seed = spec["seed"]
        honest = {"method": self.params["honest_method"]} if spec.get("honest_fraction") else None
        nodes = bag.select("row_id", "features", "y", w.alias("w"), "role", "tree").groupBy("tree").applyInPandas(
            lambda pdf: _grow_group(pdf, tree, seed, honest, permute), NODE_SCHEMA
        )
        nodes = checkpointed(nodes)
        if first:
            nodes = previous.nodes.unionByName(nodes)
        return ForestModel(nodes, task, classes, self.params, spec)


    def _grown_wide(self, base: DataFrame, spec: dict, p: TreeParams, classes: list, n_features: int) -> DataFrame:
        """Node table from passes over all rows, which are written once with their bags' weights."""
        y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1 if p.task == "class" else F.col("label")
        ids = range(spec["n_trees"])
        once = F.lit(1.0)
        mult = {t: once if spec["kind"] == "all" else F.col(f"u{t}") for t in ids}
        salt = None if spec["kind"] == "all" else f"{spec['salt']}{spec['seed']}"
        weight = F.col("weight").cast("double") if "weight" in base.columns else once
        cols = [F.get("features", F.lit(f)).alias(f"f{f}") for f in range(n_features)]
        rows = base.select("row_id", *cols, y.cast("double").alias("y"), weight.alias("_w"))
        rows, n_rows = written_rows(rows, n_features, {t: mult[t] * F.col("_w") for t in ids}, salt, spec["max_samples"])
        keys = {t: int(np.random.default_rng([spec["seed"], t]).integers(1 << 62)) for t in ids}
        trees = WideGrower(rows, keys, p, n_features, n_rows).grow()
        frame = pd.concat([_node_frame(t, tree) for t, tree in trees.items()])
        whole = {"tree", "node", "left", "right", "parent", "depth"}
        plain = lambda c, v: v if isinstance(v, list) else None if pd.isna(v) else int(v) if c in whole else v
        found = [tuple(plain(c, v) for c, v in zip(_NODE_COLUMNS, r)) for r in frame.astype(object).itertuples(index=False)]
        return checkpointed(base.sparkSession.createDataFrame(found, NODE_SCHEMA))


class _Single:
    """A single tree: one estimator over all rows."""

    DEFAULTS = {"n_estimators": 1, "bootstrap": False, "max_features": None}


class _Regressor:
    DEFAULTS = {"criterion": "squared_error", "max_features": 1.0}
    TREE = {"task": "value"}


class RandomForestClassifier(ForestEstimator):
    DEFAULTS = {"max_features": "sqrt"}


class RandomForestRegressor(_Regressor, ForestEstimator):
    pass


class ExtraTreesClassifier(RandomForestClassifier):
    DEFAULTS = {"bootstrap": False}
    TREE = {"splitter": "random"}


class ExtraTreesRegressor(RandomForestRegressor):
    DEFAULTS = {"bootstrap": False}
    TREE = {"splitter": "random"}


class DecisionTreeClassifier(_Single, ForestEstimator):
    pass


class DecisionTreeRegressor(_Single, _Regressor, ForestEstimator):
    pass


class ExtraTreeClassifier(_Single, ForestEstimator):
    DEFAULTS = {"max_features": "sqrt"}
    TREE = {"splitter": "random"}


class ExtraTreeRegressor(_Single, _Regressor, ForestEstimator):
    DEFAULTS = {"max_features": 1.0}
    TREE = {"splitter": "random"}


class ObliqueRandomForestClassifier(ForestEstimator):
    DEFAULTS = {"max_features": "sqrt"}
    TREE = {"projection": "oblique"}


class ObliqueRandomForestRegressor(_Regressor, ForestEstimator):
    TREE = {"projection": "oblique"}


class ExtraObliqueRandomForestClassifier(ObliqueRandomForestClassifier):
    TREE = {"splitter": "random"}


class ExtraObliqueRandomForestRegressor(ObliqueRandomForestRegressor):
    TREE = {"splitter": "random"}


class ObliqueDecisionTreeClassifier(_Single, ForestEstimator):
    TREE = {"projection": "oblique"}


class ObliqueDecisionTreeRegressor(_Single, _Regressor, ForestEstimator):
    DEFAULTS = {"max_features": None}
    TREE = {"projection": "oblique"}


class ExtraObliqueDecisionTreeClassifier(ObliqueDecisionTreeClassifier):
    DEFAULTS = {"max_features": "sqrt"}
    TREE = {"splitter": "random"}


class ExtraObliqueDecisionTreeRegressor(ObliqueDecisionTreeRegressor):
    TREE = {"splitter": "random"}


class _Patch:
    DEFAULTS = {"min_patch_dims": None, "max_patch_dims": None, "dim_contiguous": None, "data_dims": None, "boundary": None}
    TREE = {"projection": "patch"}


class PatchObliqueRandomForestClassifier(_Patch, ForestEstimator):
    DEFAULTS = {"max_features": "sqrt"}


class PatchObliqueRandomForestRegressor(_Patch, _Regressor, ForestEstimator):
    pass


class PatchObliqueDecisionTreeClassifier(_Patch, _Single, ForestEstimator):
    pass


class PatchObliqueDecisionTreeRegressor(_Patch, _Single, _Regressor, ForestEstimator):
    DEFAULTS = {"max_features": None}


class MultiViewRandomForestClassifier(ForestEstimator):
    DEFAULTS = {"max_features": "sqrt", "feature_set_ends": None, "apply_max_features_per_feature_set": False}
    TREE = {"projection": "multiview"}


class MultiViewDecisionTreeClassifier(_Single, MultiViewRandomForestClassifier):
    DEFAULTS = {"max_features": None}


class UnsupervisedRandomForest(ForestEstimator):
    DEFAULTS = {"criterion": "twomeans", "max_features": "sqrt", "min_samples_split": "sqrt", "bootstrap": False}
    TREE = {"task": "unsupervised"}


class UnsupervisedObliqueRandomForest(UnsupervisedRandomForest):
    DEFAULTS = {"feature_combinations": 1.5}
    TREE = {"projection": "oblique"}


class UnsupervisedDecisionTree(_Single, UnsupervisedRandomForest):
    pass


class UnsupervisedObliqueDecisionTree(_Single, UnsupervisedObliqueRandomForest):
    pass


_HONEST = {"honest_fraction": 0.5, "honest_prior": "ignore", "honest_method": "prune", "kernel_method": True, "stratify": True}


class HonestForestClassifier(ForestEstimator):
    """Each bag is parted into rows that grow the tree and rows that fill its leaves."""

    DEFAULTS = {"max_features": "sqrt", "max_samples": 1.6, "stratify_bootstrap": False, "projection": "axis", **_HONEST}


class HonestTreeClassifier(_Single, HonestForestClassifier):
    DEFAULTS = {"max_samples": None, "honest_prior": "empirical", "honest_method": "apply", "kernel_method": False}


class PermutationHonestForestClassifier(HonestForestClassifier):
    """Fitted to data whose covariates are permuted: all trees alike (one permutation of
    the rows), or each tree's bag on its own."""

    DEFAULTS = {"bootstrap": False, "max_samples": None, "honest_prior": "empirical", "honest_method": "apply", "stratify": False,
                "permute_per_tree": False, "covariate_index": None}

    def fit(self, rows: DataFrame, previous=None, permute=None) -> ForestModel:
        index = self.params["covariate_index"]
        n = rows.select(F.size("features")).first()[0]
        index = list(range(n)) if index is None else list(index)
        if self.params["permute_per_tree"]:
            return super().fit(rows, previous, permute=index)
        salt = f"perm{self.params['random_state'] or 0}"
        other = bagging.permuted(rows.select("row_id", F.col("features").alias("_f")), ["_f"], salt)
        take = F.array(*map(F.lit, index))
        mixed = F.transform("features", lambda x, i: F.when(F.array_contains(take, i), F.get("_f", i)).otherwise(x))
        joined = rows.join(other, "row_id")
        return super().fit(joined.withColumn("features", mixed).drop("_f"), previous)


class ExtendedIsolationForest(ForestEstimator):
    """Random oblique trees of depth ceil(log2(n)) over small samples; the shorter a row's
    mean path, the likelier an outlier."""

    DEFAULTS = {"max_samples": "auto", "contamination": "auto", "max_features": 1, "bootstrap": False}
    TREE = {"task": "isolation", "projection": "oblique", "splitter": "random"}

    def fit(self, rows: DataFrame, previous=None, permute=None) -> "IsolationModel":
        n = rows.count()
        size = self.params["max_samples"]
        size = min(256, n) if size == "auto" else int(size * n) if isinstance(size, float) else min(int(size), n)
        inner = type(self)(**self.params)
        inner.params = self.params | {"max_samples": size, "max_depth": max(1, math.ceil(math.log2(max(size, 2)))), "max_features": 1}
        model = ForestEstimator.fit(inner, rows.select("row_id", "features"))
        out = IsolationModel(model, size)
        if self.params["contamination"] != "auto":
            out.offset = out.score_samples(rows).agg(F.percentile("score", F.lit(float(self.params["contamination"])))).first()[0]
        return out


class IsolationModel:
    def __init__(self, model: ForestModel, size: int, offset: float = -0.5):
        self.model, self.size, self.offset = model, size, offset

    def score_samples(self, rows: DataFrame) -> DataFrame:
        """(row_id, score): -2^(-mean path / c(size))."""
        trees, norm = self.model._trees(), max(float(np_average_path(self.size)), 1e-12)
        if trees is None:
            length = self.model.nodes.filter("is_leaf").select("tree", F.col("node").alias("leaf"), (F.col("depth") + average_path(F.col("n"))).alias("l"))
            mean = self.model.apply(rows).join(length, ["tree", "leaf"]).groupBy("row_id").agg(F.avg("l").alias("l"))
            return mean.select("row_id", (-F.pow(F.lit(2.0), -F.col("l") / F.lit(norm))).alias("score"))

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                total = np.zeros(len(x))
                for flat in trees.values():
                    at = flat.apply(x)
                    total += flat.depth[at] + np_average_path(flat.n[at])
                yield pd.DataFrame({"row_id": pdf["row_id"], "score": -(2.0 ** (-total / len(trees) / norm))})

        return rows.select("row_id", "features").mapInPandas(run, "row_id long, score double")

    def decision_function(self, rows: DataFrame) -> DataFrame:
        return self.score_samples(rows).select("row_id", (F.col("score") - self.offset).alias("decision"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """(row_id, prediction): 1 for inliers, -1 for outliers."""
        return self.decision_function(rows).select("row_id", F.when(F.col("decision") >= 0, 1).otherwise(-1).alias("prediction"))


class NearestNeighborsMetaEstimator:
    """Neighbours by the forest distance of a given estimator."""

    def __init__(self, estimator: ForestEstimator | None = None, n_neighbors: int = 5, radius: float = 1.0):
        self.estimator = estimator or DecisionTreeClassifier(random_state=0)
        self.n_neighbors, self.radius = n_neighbors, radius

    def fit(self, rows: DataFrame) -> "NearestNeighborsMetaEstimator":
        self.model, self.rows = self.estimator.fit(rows), rows
        return self

    def kneighbors(self, asked: DataFrame | None = None, n_neighbors: int | None = None) -> DataFrame:
        """Neighbours of the fitted rows, or of the rows asked for, among the fitted ones."""
        return self.model.kneighbors(self.rows, n_neighbors or self.n_neighbors, asked)

    def radius_neighbors(self, radius=None) -> DataFrame:
        return self.model.radius_neighbors(self.rows, self.radius if radius is None else radius)


def compute_forest_similarity_matrix(model: ForestModel, rows: DataFrame) -> DataFrame:
    return model.similarity(rows)


def load(spark, path: str, like: ForestModel | None = None) -> ForestModel:
    """A saved model. With `like`, only its nodes, read like another model's."""
    nodes = load_model(spark, path)
    if like is not None:
        return like.with_nodes(nodes)
    about = load_about(spark, path)
    weight = about["params"].get("class_weight")
    if isinstance(weight, dict):
        about["params"]["class_weight"] = {k: v for k, v in weight["pairs"]}
    return ForestModel(nodes, about["task"], about["classes"], about["params"], about["bag"])


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and issubclass(v, (ForestEstimator, ForestModel, IsolationModel, NearestNeighborsMetaEstimator))]
