import random

import duckdb

import numpy as np

from timberline.llm import line_dedup
from timberline.llm.line_dedup import LINES_SQL, MIN_CHARS, duplicate_lines, line_variants, without_duplicates


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, min_chars=MIN_CHARS):
    """Lines of min_chars or more within one edit of an earlier one, shorter ones equal to one."""
    lines = [((i is None, i or 0, k), x) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if t is not None and x]
    out = []
    for o, x in lines:
        found = [(p, y) for p, y in lines if p < o and (x == y or min(len(x), len(y)) >= min_chars and within_one(x, y))]
        if found:
            p, y = min(found)
            out.append((None if o[0] else o[1], o[2], None if p[0] else p[1], p[2], int(x != y)))
    return out


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé fgh") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    base += ["a" * 25, "a" * 26, "a" * 27, "short", "", "Page number one of the long book 1"]

    def edit(x):
        i = rng.randrange(len(x) + 1)
        return rng.choice([x[:i] + "z" + x[i:], x[:i] + x[i + 1 :], x[:i] + "q" + x[i + 1 :], x, x[:i] + "ab" + x[i:]])

    rows = []
    for d in range(60):
        rows.append((d, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(1, 5))), "s", d))
    rows += [(100, None, None, None), (101, "", "s", 0), (102, "x\n" + base[0], "s", 1), (103, base[0] + "\n" + base[1], "s", 3)]
    return rows


SCHEMA = "doc_id long, text string, _left string, n_chars long"


def test_lines_equal_brute_force_and_sql(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, duplicate_lines(df).collect()))
    want = sorted(brute(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) > 60
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(LINES_SQL).fetchall()) == got


def test_documents(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    drop = {w[:2] for w in brute(rows)}
    want = {}
    for i, t, s, n in rows:
        if t is None or not any((i, k) in drop for k in range(t.count("\n") + 1)):
            want[i] = (t, n)
            continue
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop)
        if left.strip():
            want[i] = (left, len(left))
    out = without_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == want
    none = spark.createDataFrame([(None, "x" * 30, "", 1), (None, "x" * 30, "", 1), (7, "x" * 30, "", 1)], SCHEMA)
    assert [r.n_chars for r in without_duplicates(none).collect()] == [1]
    assert without_duplicates(df.limit(0)).count() == 0


def test_short_lines_are_compared_for_equality(spark):
    from corpus_pipeline import line_dedup

    rows = [(1, "Contents\nhome\n\n" + "x" * 30, "s", 0), (2, "Contents\nhomes\n\n" + "x" * 29, "s", 0), (3, "home\nnew", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, duplicate_lines(df, exact_chars=1).collect()))
    assert got == [(2, 0, 1, 0, 0), (2, 3, 1, 3, 1), (3, 0, 1, 1, 0)]
    kept = {r.doc_id: (r.text, r.n_chars) for r in line_dedup(spark, df, "").collect()}
    assert kept == {1: (rows[0][1], 0), 2: ("homes\n", 6), 3: ("new", 3)}


def test_variants_are_found_and_nothing_else():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé漢😀") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    line, at, cut, whole = line_variants(texts, np.full(len(texts), 2))
    assert len(line) == sum(map(len, texts))
    names = {}
    for k, i, h in zip(line.tolist(), at.tolist(), cut.tolist()):
        text = texts[k][:i] + texts[k][i + 1 :]
        assert names.setdefault(h, text) == text
    assert len(names) == len(set(names.values()))
    for text, h in zip(texts, whole.tolist()):
        assert names.get(h, text) == text


def test_long_lines_and_null_ids(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(120_000))
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(3))
    rows = [(1, long, "", 0), (2, long[:70_000] + "x" + long[70_000:], "", 0), (3, "x" + long[1:], "", 0), (4, a + "\n" + b, "", 0),
            (None, a + "\n" + c, "", 0), (None, c[:30] + "\n" + b, "", 0), (9, a, "", 0), (9, c[:30] + "z\n" + a, "", 0), (9, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, map(tuple, duplicate_lines(df).collect())))
    assert got == sorted(map(str, brute(rows)))
    kept = sorted(str(r.text) for r in without_duplicates(df).collect())
    assert kept == sorted([long, a + "\n" + b, c, c[:30] + "z", "None"])


def test_other_ids(spark):
    x = "x" * 30
    df = spark.createDataFrame([("b", x + "\n" + x), ("a", x + "y"), (None, x)], "doc_id string, text string")
    got = sorted(map(str, map(tuple, duplicate_lines(df).collect())))
    assert got == sorted(map(str, [("b", 0, "a", 0, 1), ("b", 1, "a", 0, 1), (None, 0, "a", 0, 1)]))


def test_variants_are_dealt_out_by_key_once(spark):
    docs = spark.createDataFrame([(i, f"a line of words that is long enough, number {i}") for i in range(30)], "doc_id long, text string")
    lines = line_dedup.split_lines(docs, line_dedup.MIN_CHARS, line_dedup.EXACT_CHARS, "doc_id", "text")
    links = line_dedup.near_links(line_dedup.near_candidates(docs, lines, "doc_id", "text"))
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(swap" in x and "Reused" not in x]
    assert len(dealt) == 1 and "ReusedExchange" in plan


def test_variants_are_not_written(spark, monkeypatch):
    written, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: (written.append((label, df.columns)), write(df, label))[1])
    docs = spark.createDataFrame([(0, "one line of twenty characters"), (1, "one line of twenty charactxrs\none lineof twenty characters")], "doc_id long, text string")
    got = {(r["doc_id"], r["line"], r["of_doc_id"], r["edits"]) for r in duplicate_lines(docs).collect()}
    assert got == {(1, 0, 0, 1), (1, 1, 0, 1)}
    assert {label for label, _ in written} == {"lines", "near-lines", "earlier-lines"}
