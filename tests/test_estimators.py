import numpy as np
import pandas as pd
import pytest

from timberline.plans import estimators as E
from timberline.plans.grow import Grower, TreeParams, _absolute_costs


def frame(spark, x, y=None, n=3):
    pdf = pd.DataFrame({"row_id": np.arange(len(x)), "features": [list(map(float, r)) for r in x]})
    if y is not None:
        pdf["label"] = y
    return spark.createDataFrame(pdf).repartition(n)


def accuracy(model, test, y):
    got = model.predict(test).toPandas().sort_values("row_id")["prediction"].to_numpy()
    return float((got == np.asarray(y)).mean())


def trunk(n, p, seed):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    mu = 1 / np.sqrt(np.arange(1, p + 1))
    return rng.normal(size=(n, p)) + np.where(y, 1, -1)[:, None] * mu, y


def test_forests_learn_trunk(spark):
    x, y = trunk(700, 20, 0)
    train, test = frame(spark, x[:500], y[:500]), frame(spark, x[500:])
    for kind, least in ((E.ObliqueRandomForestClassifier, 0.86), (E.RandomForestClassifier, 0.83), (E.ExtraObliqueRandomForestClassifier, 0.83)):
        model = kind(n_estimators=30, random_state=1).fit(train)
        assert accuracy(model, test, y[500:]) > least, kind
    imp = model.feature_importances().toPandas()
    assert imp["importance"].sum() == pytest.approx(1)


def test_xor_needs_no_axis_luck(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (600, 6))
    y = ((x[:, 0] + x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(int)
    train, test = frame(spark, x[:400], y[:400]), frame(spark, x[400:])
    assert accuracy(E.ObliqueRandomForestClassifier(n_estimators=30, random_state=0, max_features=12, feature_combinations=2.0).fit(train), test, y[400:]) > 0.8


def test_regressors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = x[:, 0] * 3 + x[:, 1]
    rows = frame(spark, x, y)
    for kind, c in ((E.DecisionTreeRegressor, "squared_error"), (E.ObliqueDecisionTreeRegressor, "friedman_mse"), (E.DecisionTreeRegressor, "absolute_error")):
        pred = kind(criterion=c, random_state=0).fit(rows).predict(rows).toPandas().sort_values("row_id")["prediction"]
        assert ((pred - y) ** 2).mean() < 1e-3
        if c != "absolute_error":
            assert pred.sum() == pytest.approx(y.sum())
    capped = E.DecisionTreeRegressor(max_leaf_nodes=7, random_state=0).fit(rows)
    assert capped.nodes.filter("is_leaf").count() == 7


def test_patch_multiview_and_validation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16))
    y = (x[:, [5, 6, 9, 10]].sum(1) > 0).astype(int)
    rows = frame(spark, x, y)
    patch = E.PatchObliqueRandomForestClassifier(n_estimators=20, data_dims=[4, 4], min_patch_dims=[2, 2], max_patch_dims=[2, 2], random_state=0, max_features=8)
    assert accuracy(patch.fit(rows), rows, y) > 0.95
    for wrong in ({"data_dims": [3, 4]}, {"data_dims": [4, 4], "min_patch_dims": [3, 3], "max_patch_dims": [2, 2]}):
        with pytest.raises(RuntimeError):
            E.PatchObliqueRandomForestClassifier(**wrong).fit(rows)
    view = E.MultiViewRandomForestClassifier(n_estimators=20, feature_set_ends=[8, 16], apply_max_features_per_feature_set=True, random_state=0)
    assert accuracy(view.fit(rows), rows, y) > 0.9
    with pytest.raises(ValueError):
        E.MultiViewRandomForestClassifier(feature_set_ends=[8, 15]).fit(rows)
    with pytest.raises(RuntimeError):
        E.ObliqueDecisionTreeClassifier(feature_combinations=17.0).fit(rows)
    with pytest.raises(ValueError):
        E.RandomForestClassifier(nonsense=1)


def test_honest_forest_partitions(spark):
    x, y = trunk(400, 10, 2)
    rows = frame(spark, x, y)
    model = E.HonestForestClassifier(n_estimators=10, random_state=0).fit(rows)
    bag = model.bag(rows).toPandas()
    oob = model.oob_pairs(rows).toPandas()
    for t in range(10):
        b, o = bag[bag.tree == t], set(oob[oob.tree == t].row_id)
        s, h = set(b[b.role == "structure"].row_id), set(b[b.role == "honest"].row_id)
        assert not s & h and not (s | h) & o and s | h | o == set(range(400))
    leaf_total = model.nodes.filter("is_leaf").toPandas()["value"].map(sum)
    assert (leaf_total > 0).all()  # pruning leaves no empty leaf
    proba = model.predict_proba(rows).toPandas()["proba"].map(sum)
    assert np.allclose(proba, 1)
    oob_p = model.oob_proba(rows).toPandas()
    top = oob_p.sort_values("p").groupby("row_id").tail(1).set_index("row_id")["label"]
    assert (top == pd.Series(y)[top.index]).mean() > 0.8


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    inliers = np.concatenate([rng.normal(size=(150, 2)) * 0.4 + 2, rng.normal(size=(150, 2)) * 0.4 - 2])
    x = np.concatenate([inliers, rng.uniform(-4, 4, (60, 2)) * np.array([1, -1])])
    x = x[[i for i in range(len(x)) if i < 300 or min(np.hypot(*(x[i] - 2)), np.hypot(*(x[i] + 2))) > 1.5]]
    rows = frame(spark, x)
    model = E.ExtendedIsolationForest(n_estimators=60, max_samples=100, random_state=0, feature_combinations=2.0).fit(frame(spark, inliers))
    s = model.score_samples(rows).toPandas().sort_values("row_id")["score"].to_numpy()
    out = np.arange(len(x)) >= 300
    auc = (s[out][:, None] < s[~out][None, :]).mean()
    assert auc > 0.95
    assert set(model.predict(rows).toPandas()["prediction"]) <= {-1, 1}
    toy = frame(spark, [[-2, -1], [-1, -1], [-1, -2], [1, 1], [1, 2], [2, 1], [7, 4], [-5, 9]])
    scored = E.ExtendedIsolationForest(n_estimators=100, random_state=1, contamination=0.25).fit(toy).predict(toy).toPandas().sort_values("row_id")
    assert scored["prediction"].tolist() == [1] * 6 + [-1] * 2


def test_unsupervised_similarity_and_neighbors(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 4)) + 6, rng.normal(size=(40, 4)) - 6])
    rows = frame(spark, x)
    for kind in (E.UnsupervisedRandomForest, E.UnsupervisedObliqueRandomForest):
        for criterion in ("twomeans", "fastbic"):
            model = kind(n_estimators=15, criterion=criterion, random_state=0, max_depth=2).fit(rows)
            sim = model.similarity(rows).toPandas()
            assert ((sim.i < sim.j) & (sim.sim <= 1) & (sim.sim > 0)).all()
            across = (sim.i < 40) & (sim.j >= 40)
            assert sim[~across]["sim"].mean() > 5 * max(sim[across]["sim"].sum() / 1600, 1e-9)
    labels = model.labels(rows, 0.3).toPandas().sort_values("row_id")["cluster"]
    assert labels[:40].nunique() <= 8 and not set(labels[:40]) & set(labels[40:])
    near = E.NearestNeighborsMetaEstimator(kind(n_estimators=15, random_state=0, max_depth=3), 3).fit(rows).kneighbors().toPandas()
    assert ((near.i < 40) == (near.j < 40)).mean() > 0.95


def test_quantiles_warm_start_and_save(spark, tmp_path):
    x, y = trunk(200, 5, 4)
    rows = frame(spark, x, y)
    first = E.RandomForestClassifier(n_estimators=3, random_state=0).fit(rows)
    more = E.RandomForestClassifier(n_estimators=5, random_state=0, warm_start=True).fit(rows, first)
    whole = E.RandomForestClassifier(n_estimators=5, random_state=0).fit(rows)
    key = ["tree", "node"]
    a, b = (m.nodes.toPandas().sort_values(key).reset_index(drop=True)[key + ["threshold"]] for m in (more, whole))
    pd.testing.assert_frame_equal(a, b)
    with pytest.raises(ValueError):
        E.RandomForestClassifier(n_estimators=2, warm_start=True).fit(rows, first)
    more.save(str(tmp_path / "m"))
    again = E.load(spark, str(tmp_path / "m"), more)
    assert again.apply(rows).exceptAll(more.apply(rows)).count() == 0
    alone = E.load(spark, str(tmp_path / "m"))
    assert alone.predict(rows).exceptAll(more.predict(rows)).count() == 0 and alone.classes == more.classes
    assert alone.oob_pairs(rows).exceptAll(more.oob_pairs(rows)).count() == 0
    from timberline.operators.routing import route_join

    by_join = route_join(rows.select("row_id", "features"), more.nodes, 30).select("row_id", "tree", "leaf")
    assert by_join.exceptAll(more.apply(rows)).count() == 0
    q = first.predict_quantiles(rows, rows.withColumn("t", rows["label"].cast("double")), "t", [0.0, 1.0]).toPandas()
    assert (q.q_0 <= q.q_1).all() and len(q) == 200


def test_engines_agree(spark):
    from pyspark.sql import functions as F

    from timberline.operators.projections import axis_candidates
    from timberline.plans.grow_level import grow_levels

    x, y = trunk(300, 4, 7)
    rows = frame(spark, x, y)
    bag = rows.select("row_id", F.lit(0).alias("tree"))
    level = grow_levels(bag, rows, lambda n: axis_candidates(n, 4, 4).withColumn("proj", F.col("feature")), "gini", 3, label="label", classes=[0, 1]).toPandas()
    grower = Grower(x, y, np.ones(300), TreeParams(max_depth=3, n_classes=2), np.random.default_rng(0))
    grower.projector.draw = lambda rng: [(np.array([f]), np.ones(1)) for f in range(4)]  # ties as in the plan: by feature
    tree = grower.grow()
    heap, todo = {}, [(0, 0)]
    while todo:
        k, h = todo.pop()
        heap[h] = None if tree.left[k] < 0 else (tree.proj_idx[k][0], round(tree.threshold[k], 9))
        if tree.left[k] >= 0:
            todo += [(tree.left[k], 2 * h + 1), (tree.right[k], 2 * h + 2)]
    got = {r.node: None if r.is_leaf else (r.proj_idx[0], round(r.threshold, 9)) for r in level.itertuples()}
    assert got == heap


def test_absolute_costs():
    y = np.random.default_rng(0).normal(size=50)
    want = [np.abs(y[:i] - np.median(y[:i])).sum() for i in range(1, 51)]
    assert np.allclose(_absolute_costs(y), want)


def test_class_weights_and_permutation(spark):
    x, y = trunk(200, 5, 5)
    rows = frame(spark, x, np.where(y, "yes", "no"))
    for weight in ("balanced", "balanced_subsample", {"yes": 2.0}):
        assert set(E.RandomForestClassifier(n_estimators=3, class_weight=weight, random_state=0).fit(rows).predict(rows).toPandas().prediction) <= {"yes", "no"}
    for per_tree in (False, True):
        m = E.PermutationHonestForestClassifier(n_estimators=20, permute_per_tree=per_tree, bootstrap=True, random_state=0).fit(rows)
        p = m.oob_proba(rows).filter("label = 'yes'").toPandas().set_index("row_id")["p"]
        truth = pd.Series(y)[p.index].to_numpy()
        assert abs(np.corrcoef(p, truth)[0, 1]) < 0.3


def test_models_too_large_to_send_predict_alike(spark, monkeypatch):
    x, y = trunk(120, 4, 6)
    rows = frame(spark, x, y)
    forest = E.HonestForestClassifier(n_estimators=4, max_depth=4, honest_prior="uniform", honest_method="apply", random_state=0).fit(rows)
    alone = E.ExtendedIsolationForest(n_estimators=4, max_samples=16, random_state=0).fit(rows)
    sent = [np.stack(forest.predict_proba(rows).toPandas().sort_values("row_id")["proba"]), alone.score_samples(rows).toPandas().sort_values("row_id")["score"]]
    for kernel in (True, False):
        forest.params["kernel_method"] = kernel
        sent[0] = np.stack(forest.predict_proba(rows).toPandas().sort_values("row_id")["proba"])
        with monkeypatch.context() as m:
            m.setattr(E, "MAX_SENT_BYTES", 0)
            far = forest.with_nodes(forest.nodes)
            assert np.allclose(np.stack(far.predict_proba(rows).toPandas().sort_values("row_id")["proba"]), sent[0])
    monkeypatch.setattr(E, "MAX_SENT_BYTES", 0)
    alone.model._sent = None
    assert np.allclose(alone.score_samples(rows).toPandas().sort_values("row_id")["score"], sent[1])
