"""Substring dedup: seeds on winnowed anchors, extended to repeats of whole windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from ._words import mix, slices, window_hashes, word_hashes

#: Words of the shortest repeat that counts, and of an anchor.
MIN_WORDS = 20
ANCHOR_WORDS = 5

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = (1 << 63) - 1  # stands for a null id, after all others

SEED_SCHEMA = "anchor long, context long, id long, t1 long, at long"
SPAN_SCHEMA = "id long, t1 long, at long, open boolean"


class _Spans:
    """Hashes of any span of a word sequence, by its prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.ones(n + 1, np.uint64)
        power[1:] = _BASE
        back = np.ones(n + 1, np.uint64)
        back[1:] = _INVERSE
        power, self.back = np.cumprod(power), np.cumprod(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the words from start to stop, whatever lies around them."""
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def anchors(words: np.ndarray, offsets: np.ndarray, min_words: int, width: int):
    """Winnowing: each window of `min_words` words of one text belongs to its first
    least anchor (`width` words, by hash), so equal windows have it in the same place.
    Returns (anchor hash, place, first window start, last window start) of each anchor
    that has windows."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < min_words:
        return none.view(np.uint64), none, none, none
    grams = window_hashes(words, width)
    m = n - min_words + 1
    best, where = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, min_words - width + 1):
        g = grams[j : j + m]
        less = g < best
        best[less] = g[less]
        where[less] = j
    end = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(m) + min_words <= end[:m])
    if not len(start):
        return none.view(np.uint64), none, none, none
    place = start + where[start]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(head[1:], len(start)) - 1
    return best[start[head]], place[head], start[head], start[last]


def _earliest(key: np.ndarray, ids: np.ndarray, t1: np.ndarray, at: np.ndarray):
    """Whether a row is its key's first by (id, text, at), and whether it only equals that one."""
    order = np.lexsort((at, t1, ids, key))
    head = np.ones(len(key), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    first, same = np.empty(len(key), bool), np.empty(len(key), bool)
    first[order] = head
    same[order] = ~head & (ids[order] == ids[lead]) & (t1[order] == t1[lead]) & (at[order] == at[lead])
    return first, same


def _emit(anchor, context, ids, t1, at, spread):
    """Rows for the exchange. Of the rows of a batch with one context only the earliest
    competes; later ones are settled here, and travel without a key, spread evenly.
    Rows equal to the earliest are the same place of one document, and are left to it."""
    first, same = _earliest(context, ids, t1, at)
    anchor, context, ids, t1, at, spread, first = (x[~same] for x in (anchor, context, ids, t1, at, spread, first))
    key = pa.array(anchor.view(np.int64), mask=~first)
    value = np.where(first, context, mix(spread)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [key, pa.array(value), pa.array(ids), pa.array(t1), pa.array(at)], ["anchor", "context", "id", "t1", "at"]
    )


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(_LAST), dtype=np.int64)


def _seed_batches(min_words: int, width: int):
    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                words, offsets = word_hashes(part.column("text"))
                grams, place, first, last = anchors(words, offsets, min_words, width)
                if not len(grams):
                    continue
                spans = _Spans(words)
                context = mix(spans.hash(first, last + min_words) ^ mix((place - first).astype(np.uint64)))
                text = np.searchsorted(offsets, first, side="right") - 1
                ids, t1 = _ids(part.column("id"))[text], np.asarray(part.column("t1"))[text]
                # start within the text, and number of windows (at most min_words)
                at = (first - offsets[text]) * 256 + (last - first + 1)
                yield _emit(grams & np.uint64((1 << 48) - 1), context, ids, t1, at, context + place.astype(np.uint64))

    return run


def _match_batches(batches):
    """Over rows sorted by (anchor, context, id, t1, at): rows after the first of their
    context repeat earlier text (open: false). The first of a context stays open if its
    anchor has other contexts, which may agree with it in part. Streams; keeps one row."""
    prev = None  # last row seen: anchor, context, leader's id, text and at, pending leader or None
    for b in batches:
        done = np.asarray(b.column("anchor").is_null())
        place = [np.asarray(b.column(c)) for c in ("id", "t1", "at")]
        out = [(*(x[done] for x in place), np.zeros(int(done.sum()), bool))]
        live = np.flatnonzero(~done)
        if len(live):
            a = np.asarray(b.column("anchor").fill_null(0))[live]
            c, place = np.asarray(b.column("context"))[live], [x[live] for x in place]
            n = len(a)
            new_a = np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_c = new_a.copy()
            new_c[1:] |= c[1:] != c[:-1]
            if prev is not None:
                new_a[0] = a[0] != prev[0]
                new_c[0] = new_a[0] or c[0] != prev[1]
            leader = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            lead = [np.where(leader >= 0, x[leader], prev[2][k] if prev else 0) for k, x in enumerate(place)]
            later = ~new_c & np.logical_or.reduce([x != y for x, y in zip(place, lead)])
            out.append((*(x[later] for x in place), np.zeros(int(later.sum()), bool)))
            heads = np.flatnonzero(new_c)
            pending = prev[3] if prev else None
            if len(heads):
                first_of_anchor = new_a[heads]
                joined = ~first_of_anchor  # a second or later context of its anchor
                joined[:-1] |= ~first_of_anchor[1:]
                if pending is not None and not first_of_anchor[0]:
                    out.append((*(np.array([x]) for x in pending), np.ones(1, bool)))
                last = heads[-1]
                held = bool(first_of_anchor[-1])
                show = heads[joined]
                out.append((*(x[show] for x in place), np.ones(len(show), bool)))
                pending = [x[last] for x in place] if held else None
            prev = (a[-1], c[-1], [x[-1] for x in lead], pending)
        i, t, p, o = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), pa.array(p), pa.array(o)], ["id", "t1", "at", "open"])


def _window_batches(min_words: int):
    """Single windows of the open seeds: the key is the window itself."""

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                words, offsets = word_hashes(part.column("text"))
                ids, t1 = _ids(part.column("id")), np.asarray(part.column("t1"))
                starts, owner = [], []
                for i, ats in enumerate(part.column("ats")):
                    t = np.asarray(ats.values, dtype=np.int64)
                    count = t % 256
                    s = np.repeat(t // 256, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    s = s[s + min_words <= offsets[i + 1] - offsets[i]]
                    starts.append(s)
                    owner.append(np.full(len(s), i))
                if not starts:
                    continue
                s, i = np.concatenate(starts), np.concatenate(owner)
                if not len(s):
                    continue
                at = offsets[i] + s
                key = _Spans(words).hash(at, at + min_words)
                yield _emit(key, key, ids[i], t1[i], s * 256 + 1, key + at.astype(np.uint64))

    return run


def _keep_batches(min_words: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out: list[tuple] = []
                for text, ats in zip(part.column("text"), part.column("ats")):
                    words = (text.as_py() or "").encode().split()
                    removed, spans = 0, []
                    if ats.is_valid and len(words):
                        t = np.asarray(ats.values, dtype=np.int64)
                        edge = np.zeros(len(words) + 1, np.int64)
                        first, stop = t // 256, t // 256 + t % 256 - 1 + min_words
                        fits = stop <= len(words)
                        np.add.at(edge, first[fits], 1)
                        np.add.at(edge, stop[fits], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                        spans = [{"start": int(x), "stop": int(y)} for x, y in zip(turns[::2], turns[1::2])]
                        removed = int(gone.sum())
                        left = [w for w, g in zip(words, gone.tolist()) if not g]
                    else:
                        left = words
                    out.append((len(words), removed, b" ".join(left).decode(), spans))
                n, r, kept, spans = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(kept, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    ["id", "n_words", "n_removed", "kept_text", "repeats"],
                )

    return run


def _matched(seeds: DataFrame) -> DataFrame:
    key = F.coalesce("anchor", "context")
    return seeds.repartition(key).sortWithinPartitions("anchor", "context", "id", "t1", "at").mapInArrow(_match_batches, SPAN_SCHEMA)


def without_repeats(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Removes every word inside a window of `min_words` words that also starts earlier
    (a smaller id, or the same text further left); windows are judged on the input.

    Seeds: every window belongs to one winnowed anchor of `anchor_words` words, in the
    same place in equal windows, so documents that share a window meet at its anchor.
    Extension: a seed carries a hash of the words on both sides that its windows reach.
    Seeds with the same context agree in all of these windows, and the later ones repeat
    the first: one look at the sorted seeds of an anchor, no pairs. Where an anchor has
    several contexts, their first holders may agree in part: these few are extended word
    by word, as each of their windows is matched alone. Windows found this way run
    together into the maximal repeats.

    Returns per row: id, n_words, n_removed, kept_text (kept words joined by a blank),
    repeats (spans of removed words, [start, stop)). Words are runs of characters other
    than ASCII white space, taken unchanged. Null and empty texts have no words; a null id
    comes after all others; different texts of a null or repeated id come in the order of
    their hashes; rows that repeat an id with one text are one document and are not
    earlier than each other; an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("t1"), F.col(text_col).alias("text")
    )
    seeds = texts.mapInArrow(_seed_batches(min_words, anchor_words), SEED_SCHEMA)
    found = materialize(_matched(seeds), "repeats")
    own = [F.col("id").alias("at_id"), F.col("t1").alias("at_t1")]
    same = (F.col("id") == F.col("at_id")) & (F.col("t1") == F.col("at_t1"))
    undecided = found.filter("open").groupBy(*own).agg(F.collect_list("at").alias("ats"))
    # The same exchange of texts by id serves both joins below.
    open_texts = texts.join(undecided, same, "left").filter("ats is not null").select("id", "t1", "text", "ats")
    windows = open_texts.mapInArrow(_window_batches(min_words), SEED_SCHEMA)
    settled = _matched(windows).filter("not open").select("id", "t1", "at")
    spans = found.filter("not open").select("id", "t1", "at").unionByName(settled)
    spans = spans.groupBy(*own).agg(F.collect_list("at").alias("ats"))
    rows = texts.join(spans, same, "left").select("id", "text", "ats")
    out = rows.mapInArrow(
        _keep_batches(min_words),
        "id long, n_words long, n_removed long, kept_text string, repeats array<struct<start: long, stop: long>>",
    )
    return out.withColumn("id", F.nullif("id", F.lit(_LAST))).withColumnRenamed("id", id_col)
