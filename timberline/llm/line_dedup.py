"""Line dedup by deletion neighbourhoods: lines within one edit of an earlier line go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh_name, materialize, release_memory, release_shuffles
from ._words import mix, slices

#: Shorter lines (in characters) are compared for equality only.
MIN_CHARS = 20
#: Shorter lines (in characters) are not compared at all: empty ones.
EXACT_CHARS = 1
#: Bytes of candidate lines whose variants are made at once.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LINES = 1 << 31  # more than a text can have lines

VARIANT_SCHEMA = "key long, c long"
LINE_SCHEMA = "id {id}, t1 long, line int, text string, side int"


def _whole_number(docs: DataFrame, id_col: str) -> bool:
    return isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _place(whole: bool) -> Column:
    """Place of a line in the corpus; a null id comes after all others. Whole-number ids
    and lines are packed into one decimal, which aggregates by hash."""
    if not whole:
        return F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("line").alias("line"))
    late = F.lit(str(1 << 63)).cast("decimal(20,0)")
    packed = F.coalesce(F.col("id").cast("decimal(20,0)"), late) * F.lit(_LINES).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    return packed.cast("decimal(38,0)")


def _unplaced(place: Column, whole: bool) -> tuple[Column, Column]:
    """Id and line of a place."""
    if not whole:
        return place["id"], place["line"]
    lines = F.lit(_LINES).cast("decimal(10,0)")
    line = F.pmod(place, lines)
    number = ((place - line) / lines).cast("decimal(20,0)")
    return F.when(number < F.lit(str(1 << 63)).cast("decimal(20,0)"), number).cast("long"), line.cast("int")


def _content(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def _half_keys() -> Column:
    """Keys of which two lines within one edit share one: a first or a last half.

    Lines P c S and P d S, with c and d of one character or none, have m = |P| + |S| bytes
    in common, so P or S has 8 * floor(m / 16) of them. A line of L bytes can't know the
    other's m, which is between L less its widest character and L: it gives the halves of
    both ends, which are mostly one. The lowest bit of a key tells the side.
    """
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    widest = F.when(size == F.char_length("text"), 1).otherwise(4)
    long, short = (F.floor(x / 16).cast("int") * 8 for x in (size, size - widest))
    of = lambda h: [
        F.xxhash64(h, F.substring(raw, F.lit(1), h)).bitwiseAND(F.lit(-2).cast("long")),
        F.xxhash64(h, F.substring(raw, size - h + 1, h)).bitwiseOR(F.lit(1).cast("long")),
    ]
    return F.when(long == short, F.array(*of(long))).otherwise(F.array(*of(long), *of(short)))


def split_lines(docs: DataFrame, min_chars: int, exact_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, line, a, b, halves) of every line that is compared: t1 tells the texts of
    a repeated id apart, a and b identify the line's content, halves are for near lines."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text")
    )
    n = F.char_length("text")
    a, b = _content(F.col("text"))
    return rows.filter(n >= min(min_chars, exact_chars)).select(
        "id", "t1", "line", a.alias("a"), b.alias("b"), F.when(n >= min_chars, _half_keys()).alias("halves")
    )


def _sides(lines: DataFrame) -> DataFrame:
    """(a, b, least, most): lines that share a half with another one, and the least and
    the greatest side shared. Nothing else can be within one edit."""
    unique = lines.filter("halves is not null").select("a", "b", "halves").dropDuplicates(["a", "b"])
    halves = unique.select("a", "b", F.explode("halves").alias("half"))
    shared = (
        halves.groupBy("half")
        .agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
        .filter("a0 <> a1 or b0 <> b1")
        .select("half")
    )
    side = F.col("half").bitwiseAND(F.lit(1).cast("long")).cast("int")
    return halves.join(shared, "half").groupBy("a", "b").agg(F.min(side).alias("least"), F.max(side).alias("most"))


def _line_batches(batches):
    """The wanted lines of texts."""
    for b in batches:
        for lo, hi in slices(b.column("text")):
            part = b.slice(lo, hi - lo)
            out: list[tuple] = []
            for k, (text, wanted) in enumerate(zip(part.column("text"), part.column("wanted"))):
                lines = text.as_py().split("\n")
                out += [(k, w["line"], lines[w["line"]], w["side"]) for w in wanted.as_py() if w["line"] < len(lines)]
            at, line, text, side = zip(*out) if out else ((), (), (), ())
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(rows), part.column("t1").take(rows), pa.array(line, pa.int32()), pa.array(text, pa.string()),
                 pa.array(side, pa.int32())],
                ["id", "t1", "line", "text", "side"],
            )
    release_memory()


def near_candidates(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(c, a, b, first, text, side) of each distinct line that shares a half with another
    one. c counts in the order of the lines' first places; side is the one side shared, or 2.
    A line's text comes from the document of its first place."""
    whole = _whole_number(docs, id_col)
    # grouped before it is joined, so that a common line's rows don't meet in one task
    first = lines.groupBy("a", "b").agg(F.min(F.struct(_place(whole).alias("place"), "t1")).alias("f")).join(_sides(lines), ["a", "b"])
    own, line = _unplaced(F.col("f.place"), whole)
    side = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(2)
    wanted = first.select(own.alias("wid"), F.col("f.t1").alias("wt"), F.struct(line.alias("line"), side.alias("side")).alias("w"))
    wanted = wanted.groupBy("wid", "wt").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.col(text_col).alias("text"))
    rows = texts.join(wanted, texts["id"].eqNullSafe(wanted["wid"]) & (texts["t1"] == wanted["wt"])).select("id", "t1", "text", "wanted")
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_line_batches, LINE_SCHEMA.format(id=kind))
    a, b = _content(F.col("text"))
    found = found.select(a.alias("a"), b.alias("b"), _place(whole).alias("first"), "text", "side").dropDuplicates(["a", "b"])
    return materialize(found.orderBy("first").withColumn("c", F.monotonically_increasing_id()), "near-lines")


def line_variants(texts: list[str], sides: np.ndarray):
    """Hashes of each line without one character, and of whole lines.

    Returns (line, place, cut, whole): cut is the hash of line number `line` without the
    character at `place`, with the line's length; whole[i] is line i's hash with the
    length of a line one character longer, so equal cut and whole differ by an insertion.
    Sides leave out places where no near line can differ: side 0 (a shared first half) the
    front, side 1 the rear. Work and memory grow with the characters, not with their square.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    power, back = np.full(len(codes) + 1, _BASE, np.uint64), np.full(len(codes) + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * power[:-1], out=sums[1:])
    octets = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=octets[1:])
    octets = octets.astype(np.int64)
    length = octets[stop] - octets[start]
    widest = np.where(length == sizes, 1, 4)
    half = np.maximum((length - widest) // 16 * 8, 0)
    low = np.where(sides == 0, np.searchsorted(octets, octets[start] + half), start)
    high = np.where(sides == 1, np.searchsorted(octets, octets[stop] - half), stop)
    low, high = np.minimum(low, stop), np.minimum(high, stop)
    many = np.maximum(high - low, 0)
    line = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + low[line]
    s, e = start[line], stop[line]
    cut = ((sums[at] - sums[s]) + (sums[e] - sums[at + 1]) * np.uint64(_INVERSE)) * back[s]
    cut = mix(cut + mix(sizes[line].astype(np.uint64)))
    whole = mix((sums[stop] - sums[start]) * back[start] + mix((sizes + 1).astype(np.uint64)))
    return line, at - s, cut, whole


def _variants(candidates: DataFrame, kind: str) -> DataFrame:
    """(key, c) of each variant of a line: its swap (cut and place) or its cut; or of each whole line."""

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                c = np.asarray(part.column("c"))
                line, at, cut, whole = line_variants(part.column("text").to_pylist(), np.asarray(part.column("side")))
                key = whole if kind == "whole" else cut if kind == "cut" else mix(cut ^ mix(at.astype(np.uint64) + np.uint64(1)))
                own = c if kind == "whole" else c[line]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], ["key", "c"])
        release_memory()

    return candidates.select("c", "text", "side").mapInArrow(run, VARIANT_SCHEMA)


def within_one(x: str, y: str) -> bool:
    """Whether an edit of one character, or none, makes x of y. Takes time in proportion to
    their length, which the engine's edit distance does not."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    same, most = 0, len(x)  # length of the common prefix, by halving
    while same < most:
        half = (same + most + 1) // 2
        if x[same:half] == y[same:half]:
            same = half
        else:
            most = half - 1
    return x[same + (len(x) == len(y)) :] == y[same + 1 :]


def _confirmed(mine: pa.Array, theirs: pa.Array) -> pa.Array:
    return pa.array([within_one(x.as_py(), y.as_py()) for x, y in zip(mine, theirs)], pa.bool_())


def near_links(candidates: DataFrame) -> DataFrame:
    """(a, b, earlier): the earliest line within one edit that comes before the line.

    Deleting one character gives a line's variants. Lines of one length with an equal
    variant from the same place differ by one substitution; a variant equal to a whole
    line differs from it by one insertion. In both cases the earliest holder of a key
    is all that its other holders need, so no pairs within a key are made. Each link
    found is confirmed by the edit distance of the two texts.
    """
    # variants are many times the lines and cheap to make: they are made where they are dealt out, and not written.
    # Swaps are dealt out by key once, for the earliest holders and for those that join them; the filter is the join's
    held = _variants(candidates, "swap").select(F.col("key").alias("swap"), "c").filter("swap is not null and c is not null").repartition("swap")
    lead = held.groupBy("swap").agg(F.min("c").alias("other"), F.max("c").alias("last")).filter("other < last").drop("last")
    swapped = held.join(lead, "swap").filter("other < c").select("c", "other")
    met = _variants(candidates, "cut").join(_variants(candidates, "whole").select("key", F.col("c").alias("w")), "key")
    met = met.groupBy("w", "c").agg(F.count(F.lit(1)).alias("places")).drop("places")
    longer = met.filter("w < c").select("c", F.col("w").alias("other"))
    shorter = met.filter("c < w").groupBy("w").agg(F.min("c").alias("other")).withColumnRenamed("w", "c")
    links = swapped.unionByName(longer).unionByName(shorter).distinct()
    mine = candidates.select("c", "a", "b", F.col("text").alias("mine"))
    theirs = candidates.select(F.col("c").alias("other"), F.col("first").alias("earlier"), F.col("text").alias("theirs"))
    near = links.join(mine, "c").join(theirs, "other").withColumn("ok", F.arrow_udf(_confirmed, "boolean")("mine", "theirs"))
    near = near.filter("ok")
    return near.groupBy("a", "b").agg(F.min("earlier").alias("earlier"))


def _found(docs: DataFrame, min_chars: int, exact_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, line, of, edits) of every line with an earlier one within one edit."""
    whole = _whole_number(docs, id_col)
    lines = materialize(split_lines(docs, min_chars, exact_chars, id_col, text_col), "lines")
    candidates = near_candidates(docs, lines, id_col, text_col)
    release_shuffles(docs.sparkSession)  # whole texts were dealt out for the candidates
    near = near_links(candidates)
    classes = lines.groupBy("a", "b").agg(F.min(_place(whole)).alias("first"), F.count(F.lit(1)).alias("many"))
    goal = (
        classes.join(near, ["a", "b"], "left")
        .filter("many > 1 or earlier is not null")
        .select("a", "b", F.least("first", "earlier").alias("of"), (F.coalesce(F.col("earlier") < F.col("first"), F.lit(False))).cast("int").alias("edits"))
    )
    goal = materialize(goal, "earlier-lines")
    own = lines.select("a", "b", "id", "t1", "line").join(goal, ["a", "b"]).filter(F.col("of") < _place(whole))
    return own.select("id", "t1", "line", "of", "edits")


def duplicate_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int = EXACT_CHARS
) -> DataFrame:
    """Every line that has an earlier line within one edit (an inserted, deleted or
    replaced character, or none), anywhere in the corpus.

    Lines are the parts of a text between line feeds, numbered from 0; those of fewer
    than `min_chars` characters are compared for equality only (most short lines are one
    edit from some other word), and those of fewer than `exact_chars` not at all: empty
    ones. Earlier means a smaller id, or the same id and a smaller line number; null ids
    come last. Lines are judged on the input, so in a chain of lines each one edit from
    the next only the first stays.
    Returns id, line, of_id, of_line (the earliest such line), edits (0 or 1).
    Null texts have no lines; lines of rows that repeat one id at the same place are
    not earlier than each other; an empty table gives no rows; other columns are ignored.
    """
    of_id, of_line = _unplaced(F.col("of"), _whole_number(docs, id_col))
    found = _found(docs, min_chars, exact_chars, id_col, text_col)
    kind = docs.schema[id_col].dataType
    return found.select(F.col("id").alias(id_col), "line", of_id.cast(kind).alias(f"of_{id_col}"), of_line.alias("of_line"), "edits")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines numbered; null where either is null."""
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array(lines), lambda parts: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda k: F.get(parts, k)), "\n"
    ))
    return F.when(text.isNotNull() & gone.isNotNull(), F.element_at(kept, 1))


def without_duplicates(
    docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
    exact_chars: int = EXACT_CHARS,
) -> DataFrame:
    """The documents without their duplicate lines, with all their columns.

    A text that loses all its lines of words goes with its row; texts without any
    duplicate line stay as they are, null and empty ones too. Each text loses its own lines,
    also where an id is null or repeated. `chars_col`, where there is one, is counted anew
    for changed texts.
    """
    key, own, lines, left = (fresh_name(docs, n) for n in ("_gone_id", "_gone_text", "_gone", "_left"))
    gone = _found(docs, min_chars, exact_chars, id_col, text_col)
    gone = gone.groupBy(F.col("id").alias(key), F.col("t1").alias(own)).agg(F.collect_set("line").alias(lines))
    rows = docs.join(gone, docs[id_col].eqNullSafe(gone[key]) & (F.xxhash64(docs[text_col]) == gone[own]), "left")
    # exploded, so that the filter and the columns below read the text cut once
    rows = rows.select("*", F.explode(F.array(_without(docs[text_col], F.col(lines)))).alias(left))
    rows = rows.filter(F.col(left).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    out = []
    for c in docs.columns:
        col = docs[c]
        if c == text_col:
            col = F.coalesce(F.col(left), col)
        elif c == chars_col:
            kind = docs.schema[c].dataType
            col = F.when(F.col(left).isNotNull(), F.char_length(left).cast(kind)).otherwise(col)
        out.append(col.alias(c))
    return rows.select(*out)


#: The same for DuckDB. Lines of one length that agree without the character at one
#: place differ by one substitution; a line without one character that equals another
#: differs from it by one insertion. Places are packed as id * 2^20 + line.
LINES_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS t FROM parts),
used AS (SELECT doc_id, line, t, doc_id * 1048576 + line AS o FROM lines WHERE length(t) >= {EXACT_CHARS}),
classes AS (SELECT t, min(o) AS o FROM used GROUP BY t),
long AS (SELECT * FROM classes WHERE length(t) >= {MIN_CHARS}),
variants AS (
  SELECT o, t, n, i, hash(t[1:i-1] || t[i+1:]) AS v
  FROM (SELECT o, t, length(t) AS n, unnest(range(1, length(t) + 1)) AS i FROM long)),
swaps AS (
  SELECT v.t, min(k.o) AS other FROM variants v
  JOIN (SELECT v, i, n, min(o) AS o FROM variants GROUP BY ALL HAVING count(*) > 1) k USING (v, i, n)
  WHERE k.o < v.o GROUP BY v.t),
met AS (
  SELECT DISTINCT v.t AS t1, v.o AS o1, c.t AS t2, c.o AS o2
  FROM variants v JOIN long c ON v.v = hash(c.t) AND v.n = length(c.t) + 1),
near AS (
  SELECT t, min(other) AS other FROM (
    SELECT * FROM swaps
    UNION ALL SELECT t1, o2 FROM met WHERE o2 < o1
    UNION ALL SELECT t2, o1 FROM met WHERE o1 < o2) GROUP BY t),
goal AS (
  SELECT c.t, least(c.o, coalesce(n.other, c.o)) AS of,
         CASE WHEN n.other < c.o THEN 1 ELSE 0 END AS edits
  FROM classes c LEFT JOIN near n ON c.t = n.t)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(of // 1048576 AS BIGINT) AS of_doc_id,
       CAST(of % 1048576 AS INTEGER) AS of_line, CAST(edits AS INTEGER) AS edits
FROM used JOIN goal USING (t) WHERE of < o
"""
