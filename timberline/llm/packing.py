"""Best-fit packing of token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, release_memory
from .tokens import encoder

PIECE_SCHEMA = "id long, piece int, start long, length long, ids_crc32 long"


def _pieces_batches(path: str, capacity: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text")):
                packed = enc.packed(text.as_py() or "") + tail
                n = len(packed) // 4
                cut = n % capacity or capacity
                edges = [0, *range(cut, n + 1, capacity)] if n > capacity else [0, n]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, k, lo, hi - lo, zlib.crc32(packed[4 * lo : 4 * hi])))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
        release_memory()

    return run


def fill_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Minimum bin slack over a histogram of lengths.

    Each bin starts with the longest length left; a bitset of reachable sums over
    all available lengths (each as often as it is left) finds the fullest way to
    fill the rest. That combination is removed as many times as the counts allow,
    so the work depends on the capacity and hardly on the number of pieces.
    Returns [(lengths of one bin, number of such bins)].
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    plan = []
    while left:
        order = [n for n in order if n in left]
        first = order[0]
        room = capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps, goal = 1, [], 1 << room
        for n in order:
            if n > room:
                continue
            many = min(left[n] - (n == first), room // n)
            k = 1
            while many > 0 and not reach & goal:
                take = min(k, many)
                new = (reach << (n * take)) & mask & ~reach
                if new:
                    steps.append((n, take, new))
                    reach |= new
                many -= take
                k *= 2
            if reach & goal:
                break
        at = reach.bit_length() - 1
        used = {first: 1}
        for n, take, new in reversed(steps):
            if at and new >> at & 1:
                used[n] = used.get(n, 0) + take
                at -= n * take
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append(([n for n in sorted(used, reverse=True) for _ in range(used[n])], times))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of that
    length with those ranks go to consecutive sequences, at that offset."""
    nxt: dict[int, int] = {}
    seq, out = 0, []
    for lengths, times in plan:
        at = 0
        for n in lengths:
            rank = nxt.get(n, 0)
            out.append((n, rank, rank + times, seq, at))
            nxt[n] = rank + times
            at += n
        seq += times
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_buckets: int = 1024,
) -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    A document is its token ids and `end_id`. Longer ones are cut into pieces of
    `capacity`, the first of which may be shorter. Only the histogram of piece
    lengths (at most `capacity` rows) reaches the driver; the plan made from it goes
    back as rank intervals by length, whose number depends on the capacity, and
    pieces find their place by their rank among pieces of one length.

    Returns per piece: id, piece, start, length, ids_crc32, sequence_id, offset.
    Null text is empty (one token). Repeated rows are packed each by itself; a null
    id keeps its rows. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = materialize(
        base.mapInArrow(_pieces_batches(tokenizer_path, capacity, end_id), PIECE_SCHEMA), "pieces"
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        _slots(fill_plan(counts, capacity)), "length long, lo long, hi long, seq long, offset long"
    )
    ranked = _rank_within(pieces, rank_buckets)
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    placed = ranked.join(
        s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )


def _rank_within(pieces: DataFrame, buckets: int) -> DataFrame:
    """rank from 0 among pieces of one length, without a task for a whole length."""
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    before = (
        rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    inner = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    return rows.join(before, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inner) - 1
    )


def _ids_batches(path: str, end_id: int):
    def run(batches):
        import numpy as np

        enc = encoder(path)
        for b in batches:
            seqs, offs, ids = [], [], []
            for text, places in zip(b.column("text"), b.column("places").to_pylist()):
                all_ids = np.frombuffer(enc.packed(text.as_py() or "") + end_id.to_bytes(4, "little"), "<u4")
                for p in places:
                    seqs.append(p["sequence_id"])
                    offs.append(p["offset"])
                    ids.append(all_ids[p["start"] : p["start"] + p["length"]].astype("int64"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seqs, pa.int64()), pa.array(offs, pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                ["sequence_id", "offset", "ids"],
            )

    return run


def assemble(
    docs: DataFrame,
    layout: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), from pack()'s layout.
    Ids of documents must be unique; a sequence is as long as its capacity at most."""
    places = layout.groupBy(id_col).agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places")
    )
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(places, id_col).select("text", "places")
    parts = rows.mapInArrow(_ids_batches(tokenizer_path, end_id), "sequence_id long, offset long, ids array<long>")
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )
