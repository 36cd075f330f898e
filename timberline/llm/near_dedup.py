"""MinHash near-dedup: banded candidates, odd sketches, confirmation on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, fresh_name, materialize, release_memory
from ._words import mix, slices, window_hashes, word_hashes

#: Words of a shingle, and the least Jaccard similarity of a link, in percent.
SHINGLE_WORDS = 4
PERCENT = 80
#: MinHash samples, in bands of so many rows. A pair at the threshold of 0.8 misses all
#: 32 bands of 4 with probability (1 - 0.8^4)^32 < 5e-8.
SAMPLES = 128
BAND_ROWS = 4
#: Bits of an odd sketch of the samples. Its estimate at 0.8 has a standard deviation of
#: about 0.045; it ranks a class's candidates.
SKETCH_BITS = 512
#: Bits of an odd sketch of a whole set. Its XOR has no more bits than the sets differ in
#: shingles, so it rules pairs out for certain.
PARITY_BITS = 2048

_LAST = (1 << 63) - 1

#: Bits in which the samples' sketches of a candidate may differ: more, and its estimate
#: is below 0.55, over four standard deviations (of samples and sketch, 0.057) under 0.8.
MOST_BITS = 94
#: Rows of a block of a bucket, and cells of a block's matrix that are compared at once.
BLOCK_ROWS = 1024
CELLS = 1 << 18

_LAST = (1 << 63) - 1

SIGNATURE_SCHEMA = "id long, t1 long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"
PAIR_SCHEMA = "u long, v long"
SET_SCHEMA = "d1 long, d2 long, shingles array<long>, parity array<long>"


def shingle_sets(texts: pa.Array, width: int):
    """Sorted distinct shingle hashes of each text: A-Z in lower case, `width` words, or
    all words as one shingle where there are fewer."""
    words, offsets = word_hashes(texts, fold_case=True)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        own = words[lo:hi]
        yield np.unique(window_hashes(own, min(width, len(own)))) if len(own) else own


class _Hasher:
    def __init__(self, samples: int, rows: int, bits: int):
        rng = np.random.default_rng(20)
        self.mult = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.rows, self.bits, self.samples = rows, bits, samples
        self.place = mix(np.arange(1, samples + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(self.samples, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), 1024):
            part = shingles[k : k + 1024]
            values = part[None, :] * self.mult[:, None]
            values += self.add[:, None]
            values ^= values >> np.uint64(32)
            np.minimum(best, values.min(1), out=best)
        return best

    def bands(self, signature: np.ndarray) -> np.ndarray:
        parts = mix(signature ^ self.place).reshape(-1, self.rows)
        return mix(parts.sum(1, dtype=np.uint64) + self.place[: len(parts)])

    def sketch(self, signature: np.ndarray) -> np.ndarray:
        """Parities: bit b is the number of samples that hash to b, modulo two."""
        return _parities(signature * np.uint64(3) + self.place, self.bits)


def _parities(values: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((mix(values) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimate(differing: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """Jaccard similarity from the population count of the XOR of two odd sketches:
    2 k (1 - J) differing samples toggle bits / 2 (1 - (1 - 2 / bits)^(2 k (1 - J)))
    of them on average."""
    share = np.minimum(2.0 * differing / bits, 1 - 1e-9)
    return 1 + bits / (4.0 * samples) * np.log(1 - share)


def parity_sketch(shingles: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Bit b is the number of shingles that hash to b, modulo two."""
    return _parities(shingles, bits)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(d1), int(d2)


def _lists(rows) -> pa.Array:
    """Integer arrays as one list column, without an object for each number."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _signature_batches(width: int):
    def run(batches):
        hasher, none = _Hasher(SAMPLES, BAND_ROWS, SKETCH_BITS), np.zeros(0, np.int64)
        for b in batches:
            for lo, hi in slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                n, digests, bands, sketches = [], [], [], []
                for s in shingle_sets(part.column("text"), width):
                    n.append(len(s))
                    digests.append(_digest(s) if len(s) else (0, 0))
                    signature = hasher.signature(s) if len(s) else None
                    bands.append(hasher.bands(signature).view(np.int64) if len(s) else none)
                    sketches.append(hasher.sketch(signature) if len(s) else none)
                d1, d2 = zip(*digests)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("t1"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                     pa.array(d2, pa.int64()), _lists(bands), _lists(sketches)],
                    ["id", "t1", "n", "d1", "d2", "bands", "sketch"],
                )
        release_memory()

    return run


def _set_batches(width: int):
    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                sets = [s for s in shingle_sets(part.column("text"), width) if len(s)]
                d1, d2 = zip(*map(_digest, sets)) if sets else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(sets), _lists([parity_sketch(s) for s in sets])],
                    ["d1", "d2", "shingles", "parity"],
                )
        release_memory()

    return run


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Population counts of the XOR of every sketch of x with every one of y."""
    x, y = (np.ascontiguousarray(z).view(np.uint64) for z in (x, y))
    bits = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        bits += np.bitwise_count(x[:, k][:, None] ^ y[:, k][None, :])
    return bits


def block_pairs(x: dict, y: dict | None, percent: int, best: int | None):
    """Pairs of rows of two blocks of one bucket (of x with itself if y is None) worth
    comparing in full, in index arrays of at most CELLS pairs: of different components,
    of sizes that allow the threshold, with odd sketches of their samples that differ in
    at most MOST_BITS, and whose whole sets' odd sketches allow the threshold: similarity
    of p percent and sizes a, b leave (a + b)(100 - p) / (100 + p) shingles to differ in,
    and no sketches differ in more bits than that. With `best`, for each row outside the
    bucket's largest component only so many, the likeliest by their samples; else a pair
    is given only in the first band that it shares."""
    own, y = y is None, x if y is None else y
    rows = np.flatnonzero(~x["main"]) if best else np.arange(len(x["node"]))
    if not len(y["node"]):
        return
    step = max(1, CELLS // len(y["node"]))
    for lo in range(0, len(rows), step):
        r = rows[lo : lo + step]
        a, b = x["n"][r][:, None], y["n"][None, :]
        ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (x["comp"][r][:, None] != y["comp"][None, :])
        if own and not best:
            ok &= r[:, None] < np.arange(len(y["node"]))[None, :]
        if not ok.any():
            continue
        bits = _differing(x["sketch"][r], y["sketch"])
        ok &= bits <= MOST_BITS
        if not ok.any():
            continue
        ok &= (100 + percent) * _differing(x["parity"][r], y["parity"]) <= (100 - percent) * (a + b)
        if best and len(y["node"]) > best:
            bits = np.where(ok, bits, SKETCH_BITS + 1)
            top = np.argpartition(bits, best - 1, axis=1)[:, :best]
            keep = np.zeros_like(ok)
            np.put_along_axis(keep, top, True, axis=1)
            ok &= keep
        i, j = np.nonzero(ok)
        i = r[i]
        if not best and len(i):
            first = (x["bands"][i] == y["bands"][j]).argmax(1) == x["band"][i]
            i, j = i[first], j[first]
        if len(i):
            yield i, j


def _bucket_batches(percent: int, best: int | None):
    """Over rows sorted by cell (key, p, q): candidate pairs, given out as they are found;
    one cell in memory, two blocks of a bucket at most."""
    cell = ("key", "p", "q")
    plain = ("node", "comp", "n", "band", "main", "block")

    def whole_cells(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([np.asarray(b.column(c)) for c in cell])
            cuts = (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                now = tuple(at[:, lo].tolist())
                if held and held[0] != now:
                    yield held
                    held = []
                held = held or [now]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield held

    def columns(parts) -> dict:
        t = pa.Table.from_batches(parts).combine_chunks()
        out = {c: t.column(c).to_numpy() for c in plain}
        for c in ("sketch", "parity", "bands"):
            chunks = t.column(c).chunks
            out[c] = np.concatenate([np.asarray(x.flatten()) for x in chunks]).reshape(t.num_rows, -1)
        return out

    def run(batches):
        for (_, p, q), *parts in whole_cells(batches):
            if sum(x.num_rows for x in parts) < 2:
                continue
            rows = columns(parts)
            x = {c: v[rows["block"] == p] for c, v in rows.items()}
            y = {c: v[rows["block"] == q] for c, v in rows.items()} if p != q else None
            turns = [(x, y)] if y is None or not best else [(x, y), (y, x)]
            for left, right in turns:
                for i, j in block_pairs(left, right, percent, best):
                    u, v = left["node"][i], (right or left)["node"][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
        release_memory()

    return run


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose samples' odd sketches differ in at most MOST_BITS."""
    a = sketches.select(F.col("node").alias("u"), F.col("sketch").alias("su"))
    b = sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sv"))
    words = range(SKETCH_BITS // 64)
    bits = sum((F.bit_count(F.get("su", F.lit(k)).bitwiseXOR(F.get("sv", F.lit(k)))) for k in words), F.lit(0))
    return pairs.join(a, "u").join(b, "v").filter(bits <= MOST_BITS).select("u", "v")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.join(a, "u").join(b, "v")
        .filter(100 * both >= percent * (F.size("su") + F.size("sv") - both))
        .select("u", "v")
    )


def _open_cells(members: DataFrame, comps: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, dealt to cells: a bucket's rows to
    blocks by hash, every pair of blocks (and each block) to one cell."""
    m = members.join(comps.withColumnRenamed("id", "node"), "node", "left").select(
        "key", "band", "node", F.coalesce("component_id", "node").alias("comp")
    )
    parts = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    buckets = (
        parts.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("rows").alias("rows"), F.max(F.struct("rows", "comp")).alias("top"))
        .filter("many > 1")
        .select("key", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), F.col("top.comp").alias("top"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = m.join(buckets, "key").join(sketches, "node").withColumn("block", block).withColumn("other", other)
    return rows.select(
        "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "band", "node", "comp",
        (F.col("comp") == F.col("top")).alias("main"), "n", "sketch", "parity", "bands",
    )


def _content(text_col: str):
    return F.xxhash64(F.col(text_col))


def _grouped(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, n, component) of every row: null ids as the last, t1 a hash of the text,
    component the smallest id of its group."""
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), _content(text_col).alias("t1"), F.col(text_col).alias("text")
    )
    rows = materialize(base.mapInArrow(_signature_batches(width), SIGNATURE_SCHEMA), "signatures")
    full = rows.filter("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    # a class is a node; its number is drawn once and stored, so ids need not identify it
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    held = full.join(classes.withColumnRenamed("rep", "id"), ["d1", "d2", "id"]).select("node", "n", "bands", "sketch")
    nodes = materialize(held.dropDuplicates(["node"]), "nodes")

    band = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = band.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    members = materialize(band.join(shared, "key").select("key", "band", "node", "lead"), "members")
    met = members.filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("times"))
    first = met.groupBy("node").agg(F.max(F.struct("times", (-F.col("lead")).alias("low"))).alias("m"))
    pairs = first.select((-F.col("m.low")).alias("u"), F.col("node").alias("v"))

    active = classes.join(members.select("node").distinct(), "node")
    texts = base.select("id", "text").join(active.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sets = texts.mapInArrow(_set_batches(width), SET_SCHEMA).join(active.select("d1", "d2", "node"), ["d1", "d2"])
    sets = materialize(sets.select("node", "shingles", "parity").dropDuplicates(["node"]), "sets")
    sketches = nodes.join(sets.select("node", "parity"), "node")

    tried = materialize(_likely(pairs, nodes), "pairs")
    links = materialize(_confirmed(tried, sets, percent), "links")
    comps = components(links)
    for best in (3, None):
        cells = _open_cells(members.drop("lead"), comps, sketches)
        cells = cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        pairs = cells.mapInArrow(_bucket_batches(percent, best), PAIR_SCHEMA).distinct()
        pairs = materialize(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if best:
                continue
            break
        more = materialize(_confirmed(pairs, sets, percent), "links")
        tried = tried.unionByName(pairs)
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        comps = components(links)

    named = classes.join(comps.withColumnRenamed("id", "node"), "node", "left").select(
        "d1", "d2", "rep", F.coalesce("component_id", "node").alias("group")
    )
    least = named.groupBy("group").agg(F.min("rep").alias("component"))
    named = named.join(least, "group").select("d1", "d2", "component", "group")
    own = rows.select("id", "t1", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("d1", "d2")])
    out = own.join(named, ["d1", "d2"], "left")
    return out.select("id", "t1", "n", "group", F.coalesce("component", "id").alias("component"))


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    width: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their shingle sets.

    Words are runs of characters other than ASCII white space, A-Z in lower case; a set
    holds the distinct `width`-word shingles of a whole text. Texts of one set are one
    class. Classes that share a band of MinHash samples meet in a bucket; the odd sketches
    of their samples verify the candidates, and those are confirmed on full sets. That is
    done in three rounds:
    each class with the bucket leader it meets most often; then, in buckets that still
    hold several components, each class outside the largest with the three likeliest
    others; then all pairs of different components there that neither sketches of samples
    nor odd sketches of whole sets rule out. So large groups come together over few pairs,
    and no likely link between components is left untried. A pair at the threshold is
    lost with a probability of about 1e-5 (sketch) and below 5e-8 (bands).

    Returns per row: id, n_shingles, component_id (smallest id reachable over links of at
    least `percent` percent), kept (id = component_id). Null and empty texts have no
    shingles and link with nothing. Links are between texts, so rows of a null or repeated
    id are grouped each by its own text; a null id comes after all others, its result is
    null and kept if its group has no other id. An empty table gives no rows; other
    columns are ignored.
    """
    out = _grouped(docs, percent, width, id_col, text_col)
    return out.select(
        F.nullif("id", F.lit(_LAST)).alias(id_col), F.col("n").alias("n_shingles"),
        F.nullif("component", F.lit(_LAST)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group, the one of the smallest id, with all its columns.

    A null id is the last. Where several texts of a group share that id, or all of the
    group's ids are null, the one of the least hash stays. Rows that repeat an id and a
    text are one document and stay or go together; so do texts without words, which stay.
    """
    names = {c: fresh_name(docs, f"_{c}") for c in ("id", "t1")}
    rows = _grouped(docs, percent, width, id_col, text_col).filter("group is not null")
    rows = materialize(rows.select("id", "t1", "group", "component").distinct(), "grouped")
    stays = rows.filter("id = component").groupBy("group").agg(F.min("t1").alias("keeper"))
    gone = rows.join(stays, "group").filter("id <> component or t1 <> keeper")
    gone = gone.select(F.col("id").alias(names["id"]), F.col("t1").alias(names["t1"])).distinct()
    own = F.coalesce(docs[id_col].cast("long"), F.lit(_LAST))
    return docs.join(gone, (own == gone[names["id"]]) & (F.xxhash64(docs[text_col]) == gone[names["t1"]]), "left_anti")
