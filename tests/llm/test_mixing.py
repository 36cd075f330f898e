import duckdb
import pytest
from pyspark.sql import functions as F

from timberline.llm.mixing import MIX_SQL, mix, mixed_documents


def words(n):
    return " ".join(["w"] * n)


def rows():
    out = [(i, words(i % 7), "a", 0) for i in range(400)]
    out += [(1000 + i, words(30), "b", 0) for i in range(40)]
    out += [(2000 + i, words(3), "c", 0) for i in range(20)]
    out += [(3000 + i, words(5), None, 0) for i in range(10)]
    out += [(4000, None, "d", 0), (4001, "  ", "d", 0), (None, words(4), "a", 0), (1000, words(30), "b", 0)]
    return out


SCHEMA = "doc_id long, text string, source string, _turns int"


def water_fill(size, weights, share=1.0, cap=3):
    target, fixed, total = {}, set(), sum(size.values()) * share
    while True:
        free = [s for s in size if s not in fixed]
        rest = total - sum(target[s] for s in fixed)
        w = sum(weights[s] for s in free)
        over = []
        for s in free:
            target[s] = rest * weights[s] / w
            if target[s] > cap * size[s]:
                over.append(s)
        if not over:
            return target
        for s in over:
            target[s] = cap * size[s]
            fixed.add(s)


def test_mix_near_targets_and_sql(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df).collect()), key=str)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    names = sorted((s for s in size if s), key=lambda s: s.encode()) + [None]
    want = water_fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 60
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    sql = sorted(con.execute(MIX_SQL).fetchall(), key=str)
    mine = mix(df).withColumn("target", F.round("target", 6))
    assert sorted(map(tuple, mine.collect()), key=str) == sql


def test_documents_repeat_and_edges(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] != 1000], SCHEMA)
    docs = mixed_documents(df)
    assert docs.columns == df.columns
    turns = {r.doc_id: r.taken // r.size for r in mix(df).collect() if r.taken}
    assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == turns
    assert mix(df.limit(0)).count() == mixed_documents(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, "a", 0), (2, "", None, 0)], SCHEMA)
    assert [r.taken for r in mix(only).collect()] == [0, 0]


def test_null_and_repeated_ids_have_turns_of_their_own(spark):
    data = [(None, words(3) + f" n{i}", "a", 0) for i in range(300)] + [(7, words(5) + f" r{i}", "b", 0) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df).collect()
    size = {"a": 1200, "b": 1800}
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - got[[r.source for r in got].index(s)].target) <= 12
    kept = mixed_documents(df).collect()
    assert sum(len(r.text.split()) for r in kept) == sum(r.taken for r in got)


def test_a_small_share_of_a_large_source(spark):
    """Turns far beyond the budget are left out before they are sorted, with equal results."""
    data = [(i, words(1 + i % 5), "z", 0) for i in range(3000)] + [(5000 + i, words(40), "a", 0) for i in range(10)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df, weights=(1000, 1), share=0.1).collect()
    for s in "az":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 45
