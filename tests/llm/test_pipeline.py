"""The pipeline against plain Python, stage by stage and as a whole."""

import random

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from timberline.llm.mixing import MIX_SQL

from . import test_line_dedup, test_near_dedup, test_quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 14)))
    common = [line() for _ in range(6)]
    rows, i = [], 0
    for _ in range(45):
        lines = [rng.choice(common) if rng.random() < 0.15 else line() for _ in range(rng.randint(4, 10))]
        for copy in range(rng.choice([1, 1, 2, 3])):
            text = "\n".join(lines)
            if copy:
                text = text.replace("w1", "w9", 1) if rng.random() < 0.5 else text.replace("\n", " \n  ")
            rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
            i += 1
    para = line() + " " + line()
    rows += [(800, "\n".join([para] * 3 + [line() for _ in range(5)]), "en", "a", 1), (801, None, None, None, None),
             (802, "", "en", "b", 0), (803, line(), "en", "b", 3)]
    return rows


def brute_quality(rows):
    out = []
    for r in rows:
        s = test_quality_rules.brute(r[1])
        if s["n_words"] >= 50 and 2 * s["n_repeat_words"] <= s["n_words"] and s["n_covered"] <= 0.3 * s["n_words"] and s["longest_repeat"] <= 100:
            out.append(r)
    return out


def brute_lines(rows):
    drop = {w[:2] for w in test_line_dedup.brute(rows)}
    out = []
    for i, t, lang, source, n in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop)
        if left == t:
            out.append((i, t, lang, source, n))
        elif left.strip():
            out.append((i, left, lang, source, len(left)))
    return out


def brute_near(rows, monkeypatch):
    def five(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    monkeypatch.setattr(test_near_dedup, "shingles", five)
    kept = test_near_dedup.brute(rows)
    return [r for r in rows if kept[r[0]][2]]


def brute_mix(rows, tmp_path):
    import pandas as pd

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=COLUMNS))
    con.execute("create view documents as select * from frame")
    turns = {r[0]: r[4] // r[1] for r in con.execute(MIX_SQL).fetchall() if r[4]}
    return [r for r in rows for _ in range(turns.get(r[0], 0))]


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "t/documents.parquet")
    )
    docs = spark.read.parquet(str(tmp_path / "t/documents.parquet"))
    steps = [brute_quality, brute_lines, lambda x: brute_near(x, monkeypatch), lambda x: brute_mix(x, tmp_path)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps):
        before = len(rows)
        rows = plain(rows)
        docs = stage(spark, docs, str(tmp_path / "t"))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == COLUMNS
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str), name
        assert 0 < len(rows) and len(rows) != before or name == "near_dedup"
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r[0], len(lib.encode(r[1], add_special_tokens=False).ids) + 1) for r in rows)
    packed = corpus_pipeline.run(spark, str(tmp_path / "t")).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == want
    by: dict = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by) <= -(-sum(n for _, n in want) // 2048) + 1
