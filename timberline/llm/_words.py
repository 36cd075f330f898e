"""Words of Arrow text columns as integer arrays, in slices of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about so many bytes (one text at least).
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) ranges of rows whose texts have about `limit` bytes together."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of ASCII-white-space separated texts: (codes, offsets, dictionary).

    codes are indices into dictionary, of all texts in a row; text i has those from
    offsets[i] to offsets[i + 1]. Null texts have none.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    counts[np.asarray(pc.equal(trimmed, ""))] = 0
    words = pc.list_flatten(lists)
    if counts.sum() != len(words):
        words = words.filter(pc.not_equal(words, ""))
    coded = words.dictionary_encode()
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return np.asarray(coded.indices, dtype=np.int64), offsets, coded.dictionary


def word_hashes(texts: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words and their offsets; fold_case lower-cases A-Z only."""
    import xxhash

    if fold_case:
        texts = pc.ascii_lower(texts)
    codes, offsets, words = split_words(texts)
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
    return table[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on; len(words) - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags by text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
