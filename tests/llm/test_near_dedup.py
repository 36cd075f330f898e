import random
import re

import numpy as np
import pyarrow as pa

from timberline.llm.near_dedup import SAMPLES, _Hasher, estimate, near_duplicates, shingle_sets, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, rng.choice([" ", "\n"]).join(w).replace("w1", rng.choice(["w1", "W1"])), "s", 0))
            i += 1
    base = [rng.choice(vocab) for _ in range(120)]  # a large group of near copies, chained by their edits
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w), "s", 0))
        i += 1
    rows += [(900, None, None, None), (901, "", "", 0), (902, " \t", "", 0), (903, "one", "", 0), (904, "ONE", "", 1), (905, "é É", "", 1), (906, "É É", "", 1)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, _gone string, n int"


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
        want = brute(rows)
        assert got == want and sum(not k for *_, k in want.values()) > 60
        kept = without_near_duplicates(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])


def test_edges(spark):
    df = spark.createDataFrame(corpus(1), SCHEMA)
    assert near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e", "", 0), (1, "a b c d e", "", 0), (2, "x", "", 0), (2, "x", "", 0)], SCHEMA)
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(odd).collect())
    assert got == [("1", 1, True), ("2", 2, True), ("2", 2, True), ("None", 1, False)]


def test_odd_sketch_estimates():
    hasher, rng = _Hasher(SAMPLES, 4, 512), np.random.default_rng(0)
    for j in (0.8, 0.9, 0.97):
        found = []
        for _ in range(60):
            n = 400
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            s = [hasher.sketch(hasher.signature(y)) for y in (a, b)]
            found.append(estimate(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum()))
        assert abs(np.mean(found) - j) < 0.02 and np.std(found) < 0.07
    assert [len(s) for s in shingle_sets(pa.array(["a b", None, "a b c d e", "A b C d a b c d"]), 4)] == [1, 0, 2, 4]


def test_null_and_repeated_ids_keep_their_texts(spark):
    a = " ".join(f"a{i}" for i in range(30))
    near = a + " more"
    z = " ".join(f"z{i}" for i in range(30))
    for other in (None, 5):
        rows = [(1, a, "", 0), (other, near, "", 0), (other, z, "", 0), (other, z, "", 0), (other, None, "", 0), (other, "", "", 0)]
        kept = without_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(str(r.text) for r in kept) == sorted(["None", "", a, z, z])
    rows = [(None, a, "", 0), (None, near, "", 1), (None, z, "", 2)]
    texts = {r.text for r in without_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(texts) == 2 and z in texts


def test_blocks_of_unlike_components_stream():
    """Many rows that no sketch tells apart come out in pieces of bounded size, each pair once."""
    from timberline.llm import near_dedup as nd

    n = 3000
    rows = {"node": np.arange(n), "comp": np.arange(n), "n": np.full(n, 50), "band": np.zeros(n, int), "main": np.zeros(n, bool),
            "sketch": np.zeros((n, 8), np.int64), "parity": np.zeros((n, 32), np.int64), "bands": np.zeros((n, 32), np.int64)}
    x, y = ({c: v[s] for c, v in rows.items()} for s in (slice(0, 2000), slice(2000, n)))
    found = 0
    for left, right in ((x, None), (y, None), (x, y)):
        for i, j in nd.block_pairs(left, right, 80, None):
            assert len(i) <= nd.CELLS
            found += len(i)
    assert found == n * (n - 1) // 2
    assert sum(len(i) for i, j in nd.block_pairs(x, y, 80, 3)) == 3 * 2000


def test_large_bucket_in_blocks_equals_brute_force(spark, monkeypatch):
    from timberline.llm import near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nd, "CELLS", 64)
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
