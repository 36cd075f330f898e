import random
import zlib

import numpy as np

from timberline.llm.quality_model import N_FEATURES, Machine, features, fit, score, train


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = Machine(0.3, rng.normal(size=N_FEATURES), rng.normal(size=(N_FEATURES, 8)))
    idx, val = rng.choice(N_FEATURES, 12, replace=False), rng.normal(size=12)
    pairs = sum(
        m.factors[idx[i]] @ m.factors[idx[j]] * val[i] * val[j] for i in range(12) for j in range(i)
    )
    assert np.isclose(m.raw(idx, val, np.array([0]))[0], 0.3 + m.weights[idx] @ val + pairs)


def test_features_are_defined_for_any_text():
    for t in (None, "", " \n", "x" * 100000, "a b", "퟿ é | !! ..."):
        idx, val = features(t, {})
        assert len(idx) == len(val) > 0 and idx.min() >= 0 and idx.max() < N_FEATURES and np.isfinite(val).all()


def corpus():
    rng = random.Random(1)
    good = ["the", "of", "and", "house", "tree", "river", "stone", "light"]
    rows = []
    for i in range(600):
        n = rng.randint(10, 60)
        if i % 4:
            rows.append((i, " ".join(rng.choice(good) for _ in range(n)) + ".", 1))
        else:
            rows.append((i, " | ".join(rng.choice(good).upper() + "###" for _ in range(n)), 0))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "src", 0.5) for i, t, _ in rows] + [(9000, None, None, None), (None, "the tree", "", 0.0), (3, rows[3][1], "s", 0.1)],
                                 "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0), (7, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = train(docs, labels, max_rows=300)
    got = score(docs, model).collect()
    assert len(got) == len(rows) + 3
    truth = {i: q for i, _, q in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert score(docs.limit(0), model).count() == 0
    again = train(docs, labels, max_rows=300)
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.predicted for r in score(docs, train(docs, none)).collect()] == [1]
    one = fit(np.array([1]), np.array([1.0]), np.array([0]), np.array([0.0]))
    assert one.score(np.array([1]), np.array([1.0]), np.array([0]))[0] < 0.5
