import random
import re

import pyarrow as pa
import pytest

from timberline.llm.quality_rules import keep_good, quality_stats, suffix_repeats, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, min_repeat=10):
    w = WORD.findall(text or "")
    n = len(w)
    win = {}
    for i in range(n - 2):
        win.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for v in win.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    cover = {j for i in range(n) if best[i] >= min_repeat for j in range(i, i + best[i])}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "n_covered": len(cover),
        "longest_repeat": max([0, *(b for b in best if b >= min_repeat)]),
    }


def samples():
    rng = random.Random(5)
    out = [None, "", "  \n\t ", "one", "a a a a a a a a a a a a a", "x\x1cy \x85 z", "a b c\n\na b c\n d #*|\r\n"]
    for n, v in ((60, 3), (120, 10), (200, 40), (150, 2)):
        out.append(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQ"[:v]) for _ in range(n)))
    para = " ".join(f"w{i}" for i in range(60))
    out += [para, para + "\n" + para, f"{para} x {para} y {para}", para + " " + " ".join(f"v{i}" for i in range(300)) + " " + para]
    return out


def test_stats_equal_brute_force():
    texts = samples()
    got = text_stats(pa.array(texts))
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: int(got[k][i]) for k in want} == want, t
    # one by one gives the same as all together
    for i, t in enumerate(texts):
        alone = text_stats(pa.array([t], pa.string()))
        assert all(alone[k][0] == got[k][i] for k in got)


def test_verdict(spark):
    para = " ".join(f"w{i}" for i in range(60))
    rows = [(1, para, 0), (2, para + " " + para, 0), (3, None, 0), (None, para, 1), (1, para, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id or -1, r.kept) for r in quality_stats(df).collect())
    assert got == [(-1, True), (1, True), (1, True), (2, False), (3, False)]
    kept = keep_good(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert quality_stats(df.limit(0)).count() == keep_good(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short(n):
    import numpy as np

    tied, longest = suffix_repeats(np.zeros(n, np.int64), np.array([0, n]))
    assert len(tied) == len(longest) == n
