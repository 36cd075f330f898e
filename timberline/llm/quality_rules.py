"""Quality rules: base statistics and suffix-array repetition within a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release_memory
from ._words import per_text, slices, split_words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: A repeat counts from so many words on.
MIN_REPEAT_WORDS = 10
#: A text fails if repeats cover more than this share of its words ...
MAX_COVERED = 0.3
#: ... or if one of them has more words than this.
MAX_REPEAT_WORDS = 100

STAT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_covered long, longest_repeat long"
)
#: Bytes of texts whose suffixes are sorted at once (one text at least).
SLICE_BYTES = 1 << 20


def suffix_repeats(codes: np.ndarray, offsets: np.ndarray, base: int = 3):
    """Suffix arrays of many texts at once, by prefix doubling from `base` words on.

    Suffixes are ordered by (text, words); ranks are heads of groups of suffixes that
    agree on the words compared so far, and only groups of two or more are refined.
    Returns (tied, longest): tied marks places whose `base` words occur elsewhere in
    the text; longest is, per place, the longest prefix of its suffix that another
    suffix of the text shares (the larger of its two neighbouring LCPs), exact where
    it is `base` or more and 0 elsewhere.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][text]
    place = np.arange(n)
    # first `base` words: past the end of its text, word 0
    width = int(codes.max()) + 2
    padded = np.concatenate([codes + 1, np.zeros(base, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(base):
        word = np.where(place + j < end, padded[j : j + n], 0)
        if j and width ** (j + 1) > 2**62:
            key = np.unique(key, return_inverse=True)[1]
            if (int(key.max()) + 1) * width > 2**62:
                raise OverflowError("too many words in a slice")
        key = key * width + word
    key = np.unique(key, return_inverse=True)[1]
    key = text * (int(key.max()) + 1) + key

    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(head, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    size = np.bincount(start, minlength=n)
    tied = size[rank] > 1
    levels = [(base, rank)]
    todo = order[size[start] > 1]
    h = base
    while len(todo):
        ahead = todo + h
        inside = ahead < end[todo]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        old = rank[todo]
        perm = np.lexsort((second, old))
        todo, old, second = todo[perm], old[perm], second[perm]
        at = np.arange(len(todo))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = group | np.concatenate([[True], second[1:] != second[:-1]])
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        fresh_at = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[todo] = old + (fresh_at - group_at)
        again = np.bincount(fresh_at, minlength=len(todo))[fresh_at] > 1
        h *= 2
        levels.append((h, rank))
        todo = todo[again]

    longest = np.zeros(n, np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = place
    a, b = suffixes[:-1], suffixes[1:]
    first = levels[0][1]
    close = first[a] == first[b]
    a, b = a[close], b[close]
    common = np.zeros(len(a), np.int64)
    for h, r in reversed(levels):
        pa_, pb = a + common, b + common
        ok = (pa_ < end[a]) & (pb < end[b])
        same = ok & (r[np.minimum(pa_, n - 1)] == r[np.minimum(pb, n - 1)])
        common += np.where(same, h, 0)
    for _ in range(base - 1):
        pa_, pb = a + common, b + common
        ok = (pa_ < end[a]) & (pb < end[b])
        common += ok & (codes[np.minimum(pa_, n - 1)] == codes[np.minimum(pb, n - 1)])
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return tied, longest


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def text_stats(
    texts: pa.Array,
    min_repeat_words: int = MIN_REPEAT_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat_words: int = MAX_REPEAT_WORDS,
) -> dict[str, np.ndarray]:
    """The statistics and verdict of each text; columns as STAT_SCHEMA."""
    codes, offsets, _ = split_words(texts)
    n_words = np.diff(offsets)
    n_chars = np.asarray(pc.fill_null(pc.utf8_length(texts), 0), dtype=np.int64)
    plain = texts.to_pylist()
    spaces = np.fromiter((sum(map((t or "").count, " \t\n\x0b\x0c\r")) for t in plain), np.int64, len(plain))
    symbols = np.fromiter((sum(map((t or "").count, SYMBOLS)) for t in plain), np.int64, len(plain))
    dup_lines = np.fromiter((_dup_lines(t or "") for t in plain), np.int64, len(plain))

    n = len(codes)
    tied, longest = suffix_repeats(codes, offsets)
    end = np.repeat(offsets[1:], n_words)
    triple = np.flatnonzero(tied & (np.arange(n) + 3 <= end))
    n_repeat = per_text(_cover(triple, np.full(len(triple), 3), n), offsets)
    long = np.flatnonzero(longest >= min_repeat_words)
    covered = per_text(_cover(long, longest[long], n), offsets)
    most = np.zeros(len(n_words), np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(n_words)), n_words)[long], longest[long])

    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~base_failed & (covered <= max_covered * n_words) & (most <= max_repeat_words)
    return {
        "n_words": n_words, "word_chars": n_chars - spaces, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": kept, "n_covered": covered,
        "longest_repeat": most,
    }


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _stat_batches(options: dict):
    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                stats = text_stats(part.column("text"), **options)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *map(pa.array, stats.values())], ["id", *stats]
                )
        release_memory()

    return run


def _filter_batches(text_col: str, options: dict):
    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(text_col), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(text_stats(part.column(text_col), **options)["kept"]))
        release_memory()

    return run


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Statistics and verdict of every whole text, in one pass without a shuffle.

    A word is a run of characters other than ASCII white space. Base rules fail texts
    of fewer than 50 words, or more than half of whose words lie in three-word windows
    that occur twice. The suffix array of the text's words then gives, by its
    longest-common-prefix values, every maximal repeat of `min_repeat_words` words or
    more; the union of their spans may cover at most `max_covered` of the words
    (n_covered), and the longest may have `max_repeat_words` (longest_repeat).
    Null and empty texts have no words and fail the base rules. Rows are judged one by
    one, so null or repeated ids keep their rows; other columns are ignored; an empty
    table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_stat_batches(options), f"id long, {STAT_SCHEMA}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text quality_stats() keeps, with all their columns."""
    return docs.mapInArrow(_filter_batches(text_col, options), docs.schema)
