"""Quality classifier: a factorisation machine over hashed words and text structure."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed words; structure features follow after them.
WORD_BUCKETS = 1 << 15
#: Rank of the pairwise interactions.
RANK = 8
#: Most labelled rows that the model is fitted on (those of the smallest id digests).
MAX_TRAINING_ROWS = 12_000
EPOCHS = 6

#: Edges of the structure statistics' ranges; each range is one feature.
RATIO_EDGES = (0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SIZE_EDGES = tuple(2.0**k for k in range(0, 20))
LENGTH_EDGES = tuple(float(k) for k in range(1, 16))
_STATS = (
    ("symbols", RATIO_EDGES), ("capitals", RATIO_EDGES), ("digits", RATIO_EDGES), ("punctuation", RATIO_EDGES),
    ("repeated_words", RATIO_EDGES), ("repeated_lines", RATIO_EDGES), ("bars", RATIO_EDGES), ("ended_lines", RATIO_EDGES),
    ("short_lines", RATIO_EDGES), ("n_words", SIZE_EDGES), ("n_chars", SIZE_EDGES), ("n_lines", SIZE_EDGES),
    ("word_length", LENGTH_EDGES),
)
_OFFSETS = np.cumsum([WORD_BUCKETS, *(len(e) + 1 for _, e in _STATS)])
N_FEATURES = int(_OFFSETS[-1])

_SYMBOLS = "#*$%&<>@^_~{}[]\\/+=|"
_PUNCTUATION = ".,;:!?\"'()-"


def structure(text: str, words: list[str]) -> list[float]:
    """The statistics named in _STATS. An empty text has zeros."""
    chars = max(1, len(text))
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    count = text.count
    return [
        sum(map(count, _SYMBOLS)) / chars, sum(map(str.isupper, words)) / n, sum(map(count, "0123456789")) / chars,
        sum(map(count, _PUNCTUATION)) / chars, 1 - len(set(words)) / n, 1 - len(set(lines)) / m,
        sum(map(count, ("|", "!!", "..."))) / n, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / m,
        sum(len(x) < 20 for x in lines) / m, len(words), len(text), len(lines), len(text) / n,
    ]


def features(text: str | None, buckets: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values of one whole text: words by hash with weight
    1 + ln(count), the weights of unit length together, and one of each statistic's
    ranges. buckets keeps words already hashed."""
    text = text or ""
    words = text.split()
    by: dict[int, float] = {}
    for w, c in Counter(words).items():
        k = buckets.get(w)
        if k is None:
            if len(buckets) > 400_000:
                buckets.clear()
            k = buckets[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_BUCKETS
        by[k] = by.get(k, 0.0) + 1.0 + math.log(c)
    idx = np.fromiter(by.keys(), np.int32, len(by))
    val = np.fromiter(by.values(), np.float32, len(by))
    if len(val):
        val /= np.sqrt((val * val).sum())
    own = [
        int(o + np.searchsorted(edges, x, side="right"))
        for x, (_, edges), o in zip(structure(text, words), _STATS, _OFFSETS)
    ]
    return np.concatenate([idx, np.array(own, np.int32)]), np.concatenate([val, np.full(len(own), 0.3, np.float32)])


class Machine:
    """Second-order factorisation machine with a logistic output.

    Pairwise terms cost linear time by the identity
    sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2.
    """

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Raw outputs of rows; row r has the features from starts[r] to the next start.
        Every row has one feature at least."""
        linear = np.add.reduceat(self.weights[idx] * val, starts)
        vx = self.factors[idx] * val[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares)

    def score(self, idx, val, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, starts).astype(np.float64), -30, 30)))


def fit(idx, val, starts, labels, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in shuffled batches; classes weigh alike by
    square root of their frequency. Without both classes: the constant of the labels."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    rate_of_1 = float(np.mean(labels)) if n else 0.5
    prior = min(max(rate_of_1, 1e-3), 1 - 1e-3)
    m = Machine(math.log(prior / (1 - prior)), np.zeros(N_FEATURES, np.float32),
                rng.normal(0, 0.02, (N_FEATURES, RANK)).astype(np.float32))
    if n == 0 or rate_of_1 in (0.0, 1.0):
        m.factors[:] = 0
        return m
    weight_of = {1: math.sqrt(0.5 / prior), 0: math.sqrt(0.5 / (1 - prior))}
    row_weight = np.array([weight_of[int(y)] for y in labels])
    gw = np.full(N_FEATURES, 1e-6, np.float32)
    gv = np.full((N_FEATURES, RANK), 1e-6, np.float32)
    gb = 1e-6
    ends = np.append(starts[1:], len(idx))
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            sizes = ends[rows] - starts[rows]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            take = np.repeat(starts[rows] - first, sizes) + np.arange(sizes.sum())
            i, x = idx[take], val[take]
            row = np.repeat(np.arange(len(rows)), sizes)
            vx = m.factors[i] * x[:, None]
            total = np.add.reduceat(vx, first, axis=0)
            out = m.bias + np.add.reduceat(m.weights[i] * x, first) + 0.5 * (
                (total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), first)
            )
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[rows]) * row_weight[rows]
            e = (err[row] * x).astype(np.float32)
            uniq, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, weights=e, minlength=len(uniq)).astype(np.float32) + decay * m.weights[uniq]
            per = e[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(where, weights=per[:, k], minlength=len(uniq)) for k in range(RANK)], 1).astype(np.float32)
            dv += decay * m.factors[uniq]
            db = float(err.sum())
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            gb += db * db
            m.weights[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.factors[uniq] -= 0.5 * rate * dv / np.sqrt(gv[uniq])
            m.bias -= rate * db / math.sqrt(gb)
    return m


def _rows(texts, buckets):
    parts = [features(t, buckets) for t in texts]
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    return (
        np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
        np.concatenate([[0], np.cumsum(sizes)[:-1]]),
    )


def _feature_batches(batches):
    buckets: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        parts = [features(t.as_py(), buckets) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("quality"), pa.array([p[0] for p in parts], pa.list_(pa.int32())),
             pa.array([p[1] for p in parts], pa.list_(pa.float32()))],
            ["id", "quality", "idx", "val"],
        )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, epochs: int = EPOCHS,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Fits a machine to labelled documents that are not held out.

    At most `max_rows` labels are taken, those whose ids have the smallest digests, so
    what reaches the driver is bounded: the sparse features of so many documents. Labels
    that are null or contradict each other for one id are left out, as are held-out ids. Of
    the texts of a repeated id the least one counts.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col(id_col).cast("long").alias("lab_id"), F.col(label_col).cast("int").alias("quality"))
        .filter("lab_id is not null and quality in (0, 1)")
        .filter(~held_out(F.col("lab_id")))
        .groupBy("lab_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .filter("quality = other").drop("other")
        .orderBy(F.md5(F.col("lab_id").cast("string")), "lab_id").limit(max_rows)
    )
    sample = spark.createDataFrame([tuple(r) for r in known.collect()], "lab_id long, quality int")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = base.join(F.broadcast(sample), base["id"] == sample["lab_id"]).groupBy("id", "quality").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_feature_batches, "id long, quality int, idx array<int>, val array<float>").toArrow()
    order = np.lexsort((np.asarray(got["id"].to_numpy()),))
    flat = got.combine_chunks()
    idx_lists = flat["idx"].combine_chunks() if isinstance(flat["idx"], pa.ChunkedArray) else flat["idx"]
    val_lists = flat["val"].combine_chunks() if isinstance(flat["val"], pa.ChunkedArray) else flat["val"]
    if not len(order):
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0))
    idx_lists, val_lists = idx_lists.take(pa.array(order)), val_lists.take(pa.array(order))
    y = np.asarray(flat["quality"].to_numpy())[order].astype(np.float64)
    sizes = np.diff(np.asarray(idx_lists.offsets))
    return fit(
        np.asarray(idx_lists.flatten()), np.asarray(val_lists.flatten()),
        np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), y, epochs=epochs,
    )


def held_out(id_column: Column) -> Column:
    """Ids whose CRC-32, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def _score_batches(model: Machine):
    def run(batches):
        buckets: dict = {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                scores = model.score(*_rows(part.column("text").to_pylist(), buckets))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores)], ["id", "score"])

    return run


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text: id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only the text is looked at. One pass, no shuffle; the model has a fixed size. Null
    text is empty and gets the empty text's score; repeated rows and null ids keep their
    rows (a null id is not held out); an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = base.mapInArrow(_score_batches(model), "id long, score double")
    return rows.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
