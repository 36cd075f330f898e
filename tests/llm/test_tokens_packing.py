import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from timberline.llm.packing import assemble, fill_plan, pack
from timberline.llm.tokens import encoder, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "Plain words, 12 and 345 of them.", "", None, " two  spaces\t\ttabs \n\n lines\r\nend  ",
    "Élan vital — naïve “quotes” ½ ² ³", "special <|endoftext|> inside <|startoftext|>", "日本語 текст ‮ mixed",
    "I'll they've it's HTTP_2 a1b2 İstanbul ǅ", "nbsp here \x0b\x0c \x1c \x85 x", "word " * 5000, "café ſ K",
    "Plain words, 12 and 345 of them.", "PLAIN words,  12 and 345 of them.",
]
SCHEMA = "doc_id long, text string, id string, digest int, length string"


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)


def test_encoders_equal_the_library():
    for path in (BYTE, WORD):
        lib = Tokenizer.from_file(path)
        for t in TEXTS:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert encoder(path).count(t or "") == len(ids), t
            if path == BYTE:
                assert np.frombuffer(encoder(path).packed(t or ""), "<u4").tolist() == ids


def test_token_counts_and_cache(spark, tmp_path):
    lib = Tokenizer.from_file(WORD)
    for path in (None, str(tmp_path / "cache"), str(tmp_path / "cache")):
        rows = token_counts(frame(spark), WORD, cache_path=path).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            t = TEXTS[r.doc_id] or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)
    stored = spark.read.parquet(str(tmp_path / "cache"))
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts(frame(spark).limit(0), WORD).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "a b"), (1, "d e f"), (1, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts(odd, WORD).collect()) == [1, 2, 2, 2, 3]


def test_fill_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    counts: dict[int, int] = {}
    for n in rng.integers(1, 2049, 3000):
        counts[int(n)] = counts.get(int(n), 0) + 1
    plan = fill_plan(counts, 2048)
    used: dict[int, int] = {}
    for lengths, times in plan:
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
    bins, least = sum(t for _, t in plan), -(-sum(n * c for n, c in counts.items()) // 2048)
    assert bins <= least * 1.06
    assert fill_plan({}, 10) == [] and fill_plan({3: 4}, 6) == [([3, 3], 2)]


def test_pack_is_gapless_and_round_trips(spark):
    docs = frame(spark)
    layout = pack(docs, BYTE, capacity=64)
    rows = layout.collect()
    lib = Tokenizer.from_file(BYTE)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, want in ids.items():
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert sum(r.length for r in got) == len(want)
        assert len(got) == 1 if len(want) <= 64 else all(r.length == 64 for r in got[1:])
        at = 0
        for r in got:
            part = np.array(want[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part))
            at += r.length
    whole = {r.sequence_id: r.ids for r in assemble(docs, layout, BYTE).collect()}
    for s, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            assert whole[s][at : at + r.length] == ids[r.doc_id][r.start : r.start + r.length]
            at += r.length
        assert at <= 64 and len(whole[s]) == at
    assert pack(docs.limit(0), BYTE).count() == 0
    twice = pack(docs.unionByName(docs), BYTE, capacity=64)
    assert twice.count() == 2 * len(rows)
