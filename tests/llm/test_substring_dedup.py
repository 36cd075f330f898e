import random
import re

from timberline.llm.substring_dedup import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    first, out = {}, {}
    docs = [(i is None, i or 0, WORD.findall(t or "")) for i, t, *_ in rows]
    for null, i, w in docs:
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            first[key] = min(first.get(key, (True, 1 << 63, 0)), (null, i, s))
    for null, i, w in docs:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (null, i, s):
                gone.update(range(s, s + size))
        out[None if null else i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    passages = [text(rng.randint(18, 70)) for _ in range(8)] + [["a"] * 60, ["x", "y"] * 30]
    rows = []
    for i in range(120):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            if rng.random() < 0.3:
                p = p[rng.randrange(10) :]
            k = rng.randint(0, len(w))
            w[k:k] = p
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w), "s", 1))
    rows += [(500 + i, rows[i][1], "s", 2) for i in range(0, 40, 3)]
    rows += [(900, None, None, None), (901, "", "", 0), (902, "one two", "", 0), (None, rows[5][1] + " tail", "", 0)]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, id string, at int").repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in without_repeats(df).collect()}
        assert got == brute(rows)
        assert sum(v[1] for v in got.values()) > 1000


def test_other_lengths_spans_and_edges(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, at int")
    got = {r.doc_id: r for r in without_repeats(df, min_words=9, anchor_words=3).collect()}
    want = brute(rows, 9)
    assert {k: (r.n_words, r.n_removed, r.kept_text) for k, r in got.items()} == want
    assert all(sum(x.stop - x.start for x in r.repeats) == r.n_removed for r in got.values())
    assert without_repeats(df.limit(0)).count() == 0
    twice = spark.createDataFrame([rows[0], rows[0]], "doc_id long, text string, id string, at int")
    assert len({(r.n_removed, r.kept_text) for r in without_repeats(twice).collect()}) == 1


def test_repeated_rows_keep_their_text(spark):
    rows = [(3, " ".join(f"u{i}" for i in range(45)), "s", 1)] * 2 + [(None, " ".join(f"n{i}" for i in range(30)), "s", 1)] * 2
    rows += [(7, rows[0][1] + " tail", "s", 1)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, id string, at int").repartition(parts)
        got = without_repeats(df).collect()
        want = brute(rows)
        assert want[3][1] == 0 and len(got) == len(rows)
        assert all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in got)


def test_texts_of_null_or_repeated_ids_lose_only_their_own_words(spark):
    a, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "az")
    for other in (None, 5):
        rows = [(1, a), (other, a), (other, z), (other, z), (other, a + " tail")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in without_repeats(df).collect())
        o = str(other)
        assert got == sorted([("1", 60, 0, a), (o, 60, 60, ""), (o, 60, 0, z), (o, 60, 0, z), (o, 61, 60, "tail")])
    df = spark.createDataFrame([(None, a), (None, a + " tail")], "doc_id long, text string")
    left = " ".join(r.kept_text for r in without_repeats(df).collect()).split()
    assert sorted(left) == sorted([*a.split(), "tail"])
