"""Trees from passes over the rows are those of a bag in one task."""

import numpy as np
import pytest

from timberline.plans import estimators as E
from timberline.plans import grow_wide

KINDS = {
    "best_first": lambda: E.DecisionTreeClassifier(max_leaf_nodes=9, random_state=0),
    "oblique": lambda: E.ObliqueRandomForestClassifier(n_estimators=3, max_depth=4, random_state=0),
    "regression": lambda: E.ObliqueRandomForestRegressor(n_estimators=2, max_depth=4, random_state=0, min_samples_leaf=3),
}


@pytest.mark.parametrize("kind", KINDS)
def test_equals_growth_in_one_task(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(1500, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int) if kind != "regression" else 900 + 3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(size=1500)
    rows = spark.createDataFrame([(i, v.tolist(), t.item()) for i, (v, t) in enumerate(zip(x, y))], "row_id long, features array<double>, label " + ("int" if kind != "regression" else "double"))
    cols = ["tree", "node", "left", "right", "parent", "depth", "is_leaf", "threshold", "proj_idx", "proj_w", "n", "w", "impurity", "gain", "value", "path"]
    read = lambda m: m.nodes.select(*cols).orderBy("tree", "node").collect()
    want = read(KINDS[kind]().fit(rows))
    monkeypatch.setattr(E, "MAX_BAG_ROWS", 100)
    monkeypatch.setattr(grow_wide, "BINS", 64)
    monkeypatch.setattr(E, "_grow_group", None)
    got = read(KINDS[kind]().fit(rows))
    assert len(got) == len(want) > 8
    for a, b in zip(got, want):
        for c in cols:
            assert a[c] == b[c] if c not in ("threshold", "impurity", "gain", "value") else a[c] == b[c] or a[c] == pytest.approx(b[c], rel=1e-7, abs=1e-7), (c, a, b)


@pytest.mark.parametrize("kind", KINDS)
def test_rows_alike_are_read_once(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(3000, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 4).astype(int) if kind != "regression" else np.round(x[:, 0] - x[:, 1] * x[:, 3])
    rows = spark.createDataFrame([(i, v.tolist(), t.item()) for i, (v, t) in enumerate(zip(x, y))], "row_id long, features array<double>, label " + ("int" if kind != "regression" else "double"))
    read = lambda m: m.nodes.select("tree", "node", "left", "right", "threshold", "n", "w", "value").orderBy("tree", "node").toPandas()
    want = read(KINDS[kind]().fit(rows))
    held, grower = [], E.WideGrower
    monkeypatch.setattr(E, "MAX_BAG_ROWS", 100)
    monkeypatch.setattr(E, "WideGrower", lambda r, *more: (held.append(r.count()), grower(r, *more))[1])
    got = read(KINDS[kind]().fit(rows))
    assert held == [len(np.unique(x, axis=0))]
    assert len(got) == len(want) > 8
    for c in ("tree", "node", "n", "w"):
        assert (got[c] == want[c]).all(), c
    for c in ("left", "right", "threshold"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    assert all(np.allclose(a, b) for a, b in zip(got["value"], want["value"]))


def test_draws_of_workers_are_those_of_columns(spark):
    from pyspark.sql import functions as F

    from timberline.functions.draws import poisson_count, uniform, with_uniforms

    rows = spark.createDataFrame([(i if i % 7 else None,) for i in range(-20, 300)], "row_id long")
    got = with_uniforms(rows, "bag0", "row_id", [0, 3]).select("*", uniform("bag0", "row_id", F.lit(0)).alias("a"), uniform("bag0", "row_id", F.lit(3)).alias("b"))
    assert got.count() == 320 and got.filter("u0 <> a or u3 <> b").isEmpty()
    many = with_uniforms(rows, "bag0", "row_id", [0], 1.6).select("u0", poisson_count(uniform("bag0", "row_id", F.lit(0)), 1.6).alias("a"))
    assert many.filter("u0 <> a").isEmpty() and many.agg(F.max("u0")).first()[0] > 2


def test_values_are_predicted_without_pairs_of_rows_and_trees(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(200, 3))
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0] + v[1])) for i, v in enumerate(x)], "row_id long, features array<double>, label double")
    model = E.RandomForestRegressor(n_estimators=4, max_depth=3, random_state=0).fit(rows)
    found = model.predict(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(E, "MAX_SENT_BYTES", 0)
    far = model.with_nodes(model.nodes).predict(rows).toPandas().sort_values("row_id")
    assert np.allclose(found.toPandas().sort_values("row_id")["prediction"], far["prediction"])


@pytest.mark.parametrize("criterion,leaf", [("gini", 1), ("entropy", 5)])
def test_levels_by_passes_are_those_of_the_plan(spark, monkeypatch, criterion, leaf):
    from pyspark.sql import functions as F

    from timberline.operators.projections import sparse_candidates
    from timberline.plans import grow_level

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), t.item()) for i, (v, t) in enumerate(zip(x, y))], "row_id long, features array<double>, label int")
    bag = rows.select("row_id", F.explode(F.array(F.lit(0), F.lit(3))).alias("tree")).withColumn("mult", (F.col("row_id") + F.col("tree")) % 3 + 1)
    read = lambda b: sorted(grow_level.grow_levels(b, rows, lambda n: sparse_candidates(n, 4, 3, 1.5), criterion, 3, label="label", classes=[0, 1], min_leaf=leaf).collect(), key=lambda r: (r.tree, r.node))
    plan, every = grow_level.cut_table, lambda *a, **k: 1 / 0
    for b in (bag, 2):
        monkeypatch.setattr(grow_level, "cut_table", every)  # no table of all cuts
        got = read(b)
        monkeypatch.setattr(grow_level, "cut_table", plan)
        with monkeypatch.context() as m:
            m.setattr(grow_level, "_by_passes", lambda *a: None)
            want = read(b)
        assert len(got) == len(want) > 8
        for r, q in zip(got, want):
            for c in ("tree", "node", "left", "right", "is_leaf", "proj_idx", "proj_w", "missing_left", "n", "depth"):
                assert r[c] == q[c], (c, r, q)
            for c in ("threshold", "score"):
                assert r[c] == q[c] or r[c] == pytest.approx(q[c], rel=1e-9), (c, r, q)
