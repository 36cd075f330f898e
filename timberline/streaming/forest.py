"""Forests over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def worst_trees(predictions: DataFrame, n: int, truth: str = "y", guess: str = "y_hat") -> DataFrame:
    """(tree, accuracy, rank) of the n least accurate trees, rank from 1; ties by tree."""
    from pyspark.sql import Window

    acc = predictions.groupBy("tree").agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
    w = Window.partitionBy(F.lit(0)).orderBy("accuracy", "tree")
    return acc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


class StreamDecisionForest:
    """A forest updated by micro-batches; its state is one node table per batch.

    partial_fit routes a batch to the trees' leaves, adds its class weights there and
    grows leaves that have enough new rows further. From the third batch on, with
    probability 1 / batches, the n_swaps trees that are least accurate on the batch are
    replaced by trees grown on it. Each batch writes <path>/batch=<id>; a batch that is
    replayed finds its table and changes nothing.
    """

    def __init__(self, path: str, classes: list, estimator=None, n_swaps: int = 1):
        from ..plans.estimators import RandomForestClassifier

        if not classes:
            raise ValueError("classes are needed")
        self.path, self.classes, self.n_swaps = path.rstrip("/"), list(classes), n_swaps
        self.estimator = estimator or RandomForestClassifier()
        self.model = None
        self.batches = 0

    def _table(self, spark, batch_id: int):
        target = f"{self.path}/batch={batch_id:09d}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        return target, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def partial_fit(self, rows: DataFrame, batch_id: int) -> "StreamDecisionForest":
        """rows: (row_id, features, label). May serve as the body of foreachBatch."""
        spark = rows.sparkSession
        target, there = self._table(spark, batch_id)
        if not there:
            nodes = self._first(rows) if self.model is None else self._update(rows, batch_id)
            nodes.write.mode("overwrite").parquet(target)
        self.batches += 1
        nodes = spark.read.parquet(target)
        spec = {"n_trees": self.estimator.params["n_estimators"], "seed": self.estimator.params["random_state"] or 0, "bootstrap": False,
                "kind": "all", "max_samples": None, "salt": "bag"}
        from ..plans.estimators import ForestModel

        self.model = ForestModel(nodes, "class", self.classes, self.estimator.params, spec)
        return self

    def _groups(self, rows: DataFrame, salt: str) -> DataFrame:
        from ..operators.bagging import bootstrap

        names = F.array(*[F.lit(c) for c in self.classes])
        bag = bootstrap(rows.select("row_id", F.col("features").cast("array<double>").alias("features"), "label"),
                        self.estimator.params["n_estimators"], 1.0, salt)
        return bag.select("row_id", "features", (F.array_position(names, F.col("label")) - 1).cast("double").alias("y"),
                          F.col("mult").cast("double").alias("w"), F.lit("structure").alias("role"), "tree")

    def _first(self, rows: DataFrame) -> DataFrame:
        from ..plans.estimators import NODE_SCHEMA, _grow_group

        tree, seed = self.estimator._tree_params(len(self.classes)), self.estimator.params["random_state"] or 0
        return self._groups(rows, f"s{seed}_0").groupBy("tree").applyInPandas(lambda g: _grow_group(g, tree, seed, None, None), NODE_SCHEMA)

    def _update(self, rows: DataFrame, batch_id: int) -> DataFrame:
        import numpy as np

        from ..plans.estimators import NODE_SCHEMA, _grow_group

        seed = self.estimator.params["random_state"] or 0
        params = self.estimator._tree_params(len(self.classes))
        drop = self._swapped(rows, batch_id, seed)
        fresh_seed = seed + 1000 * (batch_id + 1)

        def one(key, old, new):
            import pandas as pd

            if not len(new):
                return old
            if not len(old) or int(key[0]) in drop:
                return _grow_group(new, params, fresh_seed, None, None)
            return _extend(old, new, params, np.random.default_rng([fresh_seed, int(key[0])])) if len(new) else pd.DataFrame(old)

        groups = self._groups(rows, f"s{seed}_{batch_id}")
        return self.model.nodes.groupBy("tree").cogroup(groups.groupBy("tree")).applyInPandas(one, NODE_SCHEMA)

    def _swapped(self, rows: DataFrame, batch_id: int, seed: int) -> set[int]:
        import random

        if self.batches < 2 or random.Random(f"{seed}:{batch_id}").random() >= 1 / (self.batches + 1):
            return set()
        post = self.model.predict_proba_per_tree(rows)
        hard = post.groupBy("row_id", "tree").agg(F.max_by("label", "p").alias("y_hat")).join(rows.select("row_id", F.col("label").alias("y")), "row_id")
        return {r["tree"] for r in worst_trees(hard, self.n_swaps).collect()}


def _extend(old, new, params, rng):
    """One tree's node frame updated by new rows: leaf weights grow, full leaves split."""
    import numpy as np

    from ..plans.estimators import _node_frame
    from ..plans.grow import Grower, Tree

    tree = Tree()
    number = {}
    for r in old.sort_values("node").itertuples():
        number[r.node] = tree.add(-1, r.depth, int(r.n), r.w, r.impurity, list(r.value))
        k = number[r.node]
        tree.gain[k], tree.proj_idx[k], tree.proj_w[k] = r.gain, list(r.proj_idx), list(r.proj_w)
        tree.threshold[k] = r.threshold
    for r in old.itertuples():
        k = number[r.node]
        tree.parent[k] = number.get(r.parent, -1)
        if not r.is_leaf:
            tree.left[k], tree.right[k] = number[int(r.left)], number[int(r.right)]
    x = np.stack(new["features"].to_numpy()).astype(np.float64)
    y, w = new["y"].to_numpy(np.int64), new["w"].to_numpy(np.float64)
    grower = Grower(x, y, w, params, rng)
    at = tree.apply(x)
    for k in np.unique(at).tolist():
        rows = np.flatnonzero(at == k)
        kid = len(tree.left)
        grower.grow(tree, rows, tree.parent[k], tree.depth[k])
        if tree.left[kid] >= 0:  # the leaf takes the place of its subtree's root
            for name in ("left", "right", "threshold", "proj_idx", "proj_w", "gain"):
                getattr(tree, name)[k] = getattr(tree, name)[kid]
            tree.parent[tree.left[k]] = tree.parent[tree.right[k]] = k
        up = k
        add = np.bincount(y[rows], weights=w[rows], minlength=params.n_classes)
        while up >= 0:
            tree.value[up] = (np.asarray(tree.value[up]) + add).tolist()
            tree.n[up] += len(rows)
            tree.w[up] += float(w[rows].sum())
            up = tree.parent[up]
    return _node_frame(int(old["tree"].iloc[0]), tree)
