import re
import textwrap

import duckdb

from timberline.llm.license_scan import TEMPLATES, THRESHOLD, scan, scan_sql

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams(w):
    return set(zip(w, w[1:]))


def dice(w, template):
    a, b = grams(w), grams(template)
    return round(2 * len(a & b) / (len(a) + len(b)), 6) if a else 0


def windows(text):
    """Best aligned window of each licence: every place is tried."""
    w, best = words(text), {}
    for k, t in TEMPLATES:
        tw = words(t)
        at = {p - q for p in range(len(w) - 1) for q in range(len(tw) - 1) if w[p : p + 2] == tw[q : q + 2]}
        for s in at:
            d = dice(w[max(s, 0) : s + len(tw)], tw)
            if d >= THRESHOLD:
                best[k] = max(best.get(k, (0, 0)), (d, -max(s, 0)))
    return best


def brute(rows):
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        units = list(enumerate(lines)) + ([(-1, text)] if len(lines) > 1 else [])
        seen = set()
        for at, unit in units:
            best = {}
            for k, t in TEMPLATES:
                d = dice(words(unit), words(t))
                if d >= THRESHOLD:
                    best[k] = max(best.get(k, 0), d)
            seen |= set(best)
            out += [(i, at, None, k, d) for k, d in best.items()]
        out += [(i, -2, -s, k, d) for k, (d, s) in windows(text or "").items() if k not in seen]
    return sorted(out, key=str)


def test_scan(spark, tmp_path):
    rows = [(i, t, "x", 0) for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(100 + i, "first line\n" + t.upper().replace(" ", "  ") + "\nlast", "x", 0) for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(200 + i, " ".join(w for j, w in enumerate(t.split()) if j % 9 != 5), "x", 0) for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(300, TEMPLATES[3][1].replace(" free", "\nfree"), "x", 0), (301, None, None, None), (302, "", "", 1), (303, "one", "", 1)]
    rows += [(None, TEMPLATES[0][1], "", 1), (304, "the the the the " * 500, "", 1), (0, TEMPLATES[0][1], "x", 0)]
    notices = {k: t for k, t in TEMPLATES}
    for i, (k, t) in enumerate(TEMPLATES):
        wrapped = "\n".join(textwrap.wrap(t, 60))
        rows += [(400 + i, f"MIT-like words\n\nabout many other things of the day\n# {wrapped}\nand so on " + "more words " * 400, "x", 0)]
        rows += [(500 + i, "see here: " + t + " and read on " + " ".join(f"w{j}" for j in range(300)), "x", 0)]
    rows += [(600, notices["ISC"] + "\n" + "text between " * 50 + "\n" + wrapped.lower() + " " + notices["Zlib"][:300], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, dice int")
    got = sorted((tuple(r) for r in scan(df).collect()), key=str)
    assert got == brute(rows) and len(got) > 60
    found = {(r[0], r[3]) for r in got}
    assert all((base + i, k) in found for base in (400, 500) for i, (k, _) in enumerate(TEMPLATES))
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(scan_sql()).fetchall(), key=str) == got
    assert scan(df.limit(0)).count() == 0
