import math

import numpy as np
import pandas as pd
import pytest

from timberline.functions import special
from timberline.functions.draws import uniform
from timberline.operators import bagging, info
from timberline.operators.projections import resolve_feature_combinations, resolve_max_features, resolve_view_features
from timberline.plans import estimators as E
from timberline.plans import testing
from timberline.sources import generators as gen


def data(spark, shift, n=60, p=5):
    rng = np.random.default_rng(0)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, p)) + shift * y[:, None]
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "features": list(map(list, x.tolist())), "label": y}))


@pytest.mark.parametrize("shift,low", [(3.0, True), (0.0, False)])
def test_coleman_pvalues(spark, shift, low):
    kind = {"n_estimators": 30, "random_state": 0, "bootstrap": True, "max_samples": 1.6}
    rows = data(spark, shift)
    got = testing.build_coleman_forest(E.HonestForestClassifier(**kind), E.PermutationHonestForestClassifier(**kind), rows, "auc", 200)
    assert (got.pvalue <= 0.05) == low and 0 < got.pvalue <= 1
    assert got.null_dist.count() == 200


def test_cv_and_permutation_forests(spark):
    rows = data(spark, 2.0)
    folds = testing.build_cv_forest(E.RandomForestClassifier(n_estimators=5, random_state=0), rows, cv=3)
    tested = [set(s.toPandas().row_id) for _, s in folds]
    assert len(folds) == 3 and sorted(x for t in tested for x in t) == list(range(60))
    kind = {"n_estimators": 8, "random_state": 0, "bootstrap": True, "max_samples": 1.0}
    got = testing.build_permutation_forest(E.HonestForestClassifier(**kind), E.PermutationHonestForestClassifier(**kind), rows, "auc", 3)
    assert got.pvalue == pytest.approx(0.25)
    with pytest.raises(RuntimeError):
        testing.build_oob_forest(E.RandomForestClassifier(bootstrap=False), rows)
    with pytest.raises(RuntimeError):
        testing.build_coleman_forest(E.HonestForestClassifier(), E.HonestForestClassifier(), rows, "nonsense")


def test_average_path_and_digamma(spark):
    want = {0: 0.0, 1: 0.0, 2: 1.0, 5: 2 * (math.log(4) + special.EULER) - 8 / 5, 999: 2 * (math.log(998) + special.EULER) - 2 * 998 / 999}
    rows = spark.createDataFrame([(k,) for k in want], "n int")
    for r in rows.select("n", special.average_path(rows["n"]).alias("c")).collect():
        assert r.c == pytest.approx(want[r.n]) == pytest.approx(float(special.np_average_path(r.n)))
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 7.5, 100.0)], "x double")
    known = {0.5: -1.9635100260214235, 1.0: -0.5772156649015329, 2.0: 0.42278433509846713, 7.5: 1.9467574842454636, 100.0: 4.600161852738087}
    for r in rows.select("x", special.digamma(rows["x"]).alias("d")).collect():
        assert r.d == pytest.approx(known[r.x], abs=1e-6) == pytest.approx(special.np_digamma(r.x), abs=1e-9)


def test_gaussian_information(spark):
    cov = np.array([[1.0, 0.6], [0.6, 1.0]])
    truth = special.mi_gaussian(cov)
    assert truth == pytest.approx(-0.5 * math.log(1 - 0.36))
    h = special.entropy_gaussian
    assert truth == pytest.approx(h([[1.0]]) * 2 - h(cov))
    big = np.array([[1, 0.5, 0.5], [0.5, 1, 0.5], [0.5, 0.5, 1.0]])
    partial = (0.5 - 0.25) / (1 - 0.25)
    assert special.cmi_gaussian(big, [0], [1], [2]) == pytest.approx(-0.5 * math.log(1 - partial**2))
    rows = gen.simulate_multivariate_gaussian(spark, [0, 0], cov, 700).selectExpr("row_id", "features[0] a", "features[1] b")
    assert info.mutual_info_ksg(rows, ["a"], ["b"], k=5).first().mi == pytest.approx(truth, abs=0.09)
    rows = gen.simulate_multivariate_gaussian(spark, [0, 0, 0], big, 700).selectExpr("row_id", "features[0] a", "features[1] b", "features[2] c")
    assert info.mutual_info_ksg(rows, ["a"], ["b"], ["c"], k=5).first().mi == pytest.approx(special.cmi_gaussian(big, [0], [1], [2]), abs=0.09)


def test_numeric_and_sampled_information_agree(spark):
    means, covs = [[1.0, 1.0], [-1.0, -1.0]], [[[1.0, 0.5], [0.5, 1.0]], [[1.0, -0.5], [-0.5, 1.0]]]
    grid = info.grid_mutual_information(spark, means, covs, [0.5, 0.5]).first().mi
    rows = gen.make_gaussian_mixture(spark, means, covs, 4000).selectExpr("row_id", "view0[0] a", "view0[1] b")
    assert info.sampled_mutual_information(rows, ["a", "b"], means, covs, [0.5, 0.5]).first().mi == pytest.approx(grid, abs=0.05)


def test_generators(spark):
    a = gen.make_trunk_classification(spark, 2000, 6, 4, mu_1=2.0, rho=0.4, seed=3)
    x = np.array(a.orderBy("row_id").toPandas()["features"].tolist())
    assert np.allclose(x[1000:].mean(0)[:4], 2 / np.sqrt([1, 2, 3, 4]), atol=0.15) and np.allclose(x[:1000].mean(0), 0, atol=0.15)
    assert np.corrcoef(x[:1000, 0], x[:1000, 1])[0, 1] == pytest.approx(0.4, abs=0.1)
    assert a.exceptAll(gen.make_trunk_classification(spark, 2000, 6, 4, mu_1=2.0, rho=0.4, seed=3)).count() == 0
    for name, parts in gen.MARRON_WAND.items():
        assert sum(w for w, *_ in parts) == pytest.approx(1), name
        assert gen.make_marron_wand_classification(spark, 20, 3, 2, name).count() == 20
    for bad in (lambda: gen.make_trunk_classification(spark, 10, 2, 3), lambda: gen.make_marron_wand_classification(spark, 10, simulation="x"),
                lambda: gen.make_trunk_mixture_classification(spark, 10, mix=2.0), lambda: gen.covariance_table(spark, 3, 0.1, "zz")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        gen.simulate_multivariate_gaussian(spark, [0, 0], [[1, 2], [2, 1]], 5)
    s = gen.simulate_sphere(spark, 50).toPandas()
    assert np.allclose(s.x**2 + s.y**2 + s.z**2, 1)
    j = gen.make_joint_factor_model(spark, 2, [4, 3], 50, 2).first()
    assert len(j.view0) == 4 and len(j.view1) == 3 and len(j.factors) == 2
    for t in ("linear", "poly", "sin", lambda c: c * 2):
        assert gen.make_gaussian_mixture(spark, [[0.0], [3.0]], [[[1.0]], [[1.0]]], 10, t, noise=0.1, noise_dims=2).count() == 10


def test_parameter_rules():
    assert resolve_max_features("sqrt", 1) == 1 and resolve_max_features(0.3, 10) == 3 and resolve_max_features(None, 7) == 7
    assert resolve_feature_combinations(None, 1) == 1 and resolve_feature_combinations(None, 9) == 1.5
    assert resolve_view_features(0.5, [6, 4]) == [3, 2] and resolve_view_features("sqrt", [5, 4]) == [3, 2]
    for wrong in (9, [1], 0):
        with pytest.raises(ValueError):
            resolve_view_features(wrong, [5, 4])


def test_bags(spark):
    rows = spark.range(2000).withColumnRenamed("id", "row_id").selectExpr("row_id", "int(row_id % 3 = 0) as label")
    bag = bagging.bootstrap(rows, 5, 1.6)
    oob = bagging.out_of_bag(rows, bag, 5)
    assert bag.select("row_id", "tree").intersect(oob).count() == 0 and bag.select("row_id", "tree").union(oob).count() == 10000
    assert bag.agg({"mult": "avg"}).first()[0] * bag.count() / 10000 == pytest.approx(1.6, abs=0.1)
    strat = bagging.stratified_bootstrap(rows, 2, "label").groupBy("tree", "label").sum("mult").toPandas()
    assert sorted(strat["sum(mult)"]) == [667, 667, 1333, 1333]
    mixed = bagging.permuted(rows, ["label"])
    assert mixed.groupBy("label").count().exceptAll(rows.groupBy("label").count()).count() == 0
    assert rows.select(uniform("a", "row_id").alias("u")).agg({"u": "avg"}).first()[0] == pytest.approx(0.5, abs=0.03)


def test_restricted_permutation(spark):
    pdf = pd.DataFrame([(i, (i + k) % 10, k) for i in range(10) for k in (1, 2, 3)], columns=["i", "j", "rank"])
    got = info.restricted_permutation(spark.createDataFrame(pdf)).toPandas()
    assert len(got) == 10 and all((p - r) % 10 in (1, 2, 3) for r, p in zip(got.row_id, got.picked)) and got.picked.nunique() >= 7


def test_stream_forest_learns_and_replays(spark, tmp_path):
    from timberline.streaming.forest import StreamDecisionForest

    rng = np.random.default_rng(0)

    def batch(k):
        y = np.arange(150) % 2
        x = rng.normal(size=(150, 4)) + y[:, None] * 1.5
        return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(150) + 1000 * k, "features": list(map(list, x.tolist())), "label": y}))

    stream = StreamDecisionForest(str(tmp_path / "s"), [0, 1], E.RandomForestClassifier(n_estimators=5, random_state=0))
    batches = [batch(k) for k in range(4)]
    sizes = []
    for k, b in enumerate(batches):
        stream.partial_fit(b, k)
        sizes.append(stream.model.nodes.count())
    assert sizes[-1] > sizes[0]
    test = batch(9)
    got = stream.model.predict(test).join(test, "row_id").toPandas()
    assert (got.prediction == got.label).mean() > 0.85
    total = stream.model.nodes.filter("node = 0").toPandas()["value"].map(sum)
    assert (total > 400).all()
    again = StreamDecisionForest(str(tmp_path / "s"), [0, 1], E.RandomForestClassifier(n_estimators=5, random_state=0))
    again.partial_fit(batches[0], 0)
    assert again.model.nodes.count() == sizes[0]
    with pytest.raises(ValueError):
        StreamDecisionForest(str(tmp_path), [])
