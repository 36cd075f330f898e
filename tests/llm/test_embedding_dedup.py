import math

import numpy as np
import pytest

from timberline.llm.embedding_dedup import near_vectors, threshold_pairs


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def points(seed, n=1500, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return unit(np.concatenate([x, x[:300] + rng.normal(size=(300, d)) * 0.15, x[:20]]))


@pytest.mark.parametrize("cosine", [0.5, 0.93, 0.999])
def test_threshold_pairs_are_exact(cosine):
    x = points(0)
    got = [p for i, j in threshold_pairs(x, None, cosine) for p in zip(i.tolist(), j.tolist())]
    assert sorted(got) == sorted(map(tuple, np.argwhere(np.triu(x @ x.T >= cosine, 1)).tolist()))
    a, b = x[:700], x[700:]
    got = [p for i, j in threshold_pairs(a, b, cosine) for p in zip(i.tolist(), j.tolist())]
    assert sorted(got) == sorted(map(tuple, np.argwhere(a @ b.T >= cosine).tolist()))
    assert not list(threshold_pairs(x[:0], None, cosine)) and not list(threshold_pairs(x[:1], None, cosine))


def brute(rows, cosine=0.93):
    ok = {}
    for i, v, label, *_ in rows:
        if v and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok[i] = (np.array(v, np.float32).astype(float), label)
    links = {i: set() for i, *_ in rows}
    ids = sorted(ok)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            (u, p), (v, q) = ok[a], ok[b]
            if p == q and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in sorted(links):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def rows(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 8))
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 8)) * 0.3, x[:30], x[:5] * 3, np.repeat(x[:1], 40, 0)])
    out = [(int(i), [float(np.float32(c)) for c in v], int(i) % 3 if i < 250 else 0, "z") for i, v in enumerate(x)]
    out += [(1000, None, 1, ""), (1001, [0.0] * 8, 1, ""), (1002, [1.0, None] + [0.0] * 6, 1, ""), (1003, [float("nan")] * 8, 1, ""),
            (1004, [float("inf")] + [1.0] * 7, 1, ""), (1005, out[0][1], None, ""), (1006, [1.0, 2.0], 1, ""), (1007, [], 1, "")]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


@pytest.mark.parametrize("block", [4096, 12])
def test_equals_brute_force(spark, block):
    data = rows(block)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block_rows=block, max_pivots=6).collect()}
    assert got == brute(data)


def test_edges(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    assert near_vectors(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1, ""), (3, [1.0], 1, ""), (3, [1.0], 1, ""), (4, [2.0], 1, "")], SCHEMA)
    got = sorted((str(r.vec_id), r.component_id, r.kept) for r in near_vectors(odd).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("4", 3, False), ("None", None, True)]


def test_a_block_of_near_vectors_needs_little_memory():
    """Nodes within the threshold are linked whole, and links are counted as they come."""
    import tracemalloc

    import pyarrow as pa

    from timberline.llm import embedding_dedup as ed

    rng = np.random.default_rng(0)
    for spread, n in ((0.004, 4096), (0.03, 1500)):
        x = np.eye(64)[0] + spread * rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        block = pa.table({"id": np.arange(n), "copies": np.ones(n, np.int64), "side": np.zeros(n, int), "cross": np.zeros(n, bool),
                          "unit": pa.array(list(x), pa.list_(pa.float64()))})
        tracemalloc.start()
        got = ed._task(block, 0.93).to_pandas().set_index("id")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = (x @ x.T >= 0.93).sum(1) - 1
        assert (got["n_links"].reindex(range(n)).fillna(0) == want).all()
        assert peak < 300 << 20, (spread, peak >> 20)
