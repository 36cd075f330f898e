"""Tokenizer access in executors, and token counts through a digest cache."""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release_memory, scratch_path

#: A worker forgets its word cache beyond this many words.
CACHE_WORDS = 200_000


def _char_class(first: str) -> str:
    """Regex class body of the characters below U+0250 whose category starts so."""
    return "".join(f"\\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i))[0] == first)


#: Texts of these characters only (Latin letters, ASCII, no rare controls or
#: spaces) are split into words here; all others go to the library whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")


def _plain(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


class _ByteBpe(dict):
    """Word -> packed little-endian uint32 ids, for byte-level BPE files.

    Words come from the byte-level splitting rule, which merges never cross, so
    the ids of a text are those of its words in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        letters, digits = _char_class("L"), _char_class("N")
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+"
            rf"| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+"
        ).findall
        self.piece = self._ranked(path)

    def _ranked(self, path: str):
        """An encoder of single words by merge ranks. Taken only if the file lists
        its merges in the order of the ids they make; else the library does it."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        made = [vocab.get(m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)) for m in merges]
        if made != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        # byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        alphabet = {chr(b): b for b in own}
        alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)
        }
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        return core._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = (
            self.piece(word.encode())
            if self.piece
            else self.library.encode(word, add_special_tokens=False).ids
        )
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def packed(self, text: str) -> bytes:
        if _plain(text):
            return b"".join(map(self.__getitem__, self.words(text)))
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


class _WordBpe(dict):
    """Word -> number of tokens, for the lower-casing BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        letters, digits = _char_class("L"), _char_class("N")
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]" rf"|[^\s{letters}{digits}]+"
        ).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = len(self.library.encode(word, add_special_tokens=False).ids)
        return n

    def count(self, text: str) -> int:
        if _plain(text):
            return sum(map(self.__getitem__, self.words(text.lower())))
        return len(self.library.encode(text, add_special_tokens=False).ids)


class _Library:
    """Any other tokenizers file, text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def packed(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


class _Pieces:
    """A sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def packed(self, text: str) -> bytes:
        ids = self.model.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))


def _kind(path: str) -> str:
    """Which of the classes above serves a file; decided from the file itself."""
    if path.endswith(".model"):
        return "pieces"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("post_processor") or model.get("type") != "BPE" or model.get("dropout"):
        return "library"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte_bpe"
    splits = [
        p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", []) if p.get("type") == "Split"
    ]
    lower = [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if lower and splits == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]:
        return "word_bpe"
    return "library"


def encoder(path: str):
    """The encoder for a vocabulary file, kept for the life of the worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = sys.__dict__.setdefault("_timberline_encoders", {})
    if path not in kept:
        kinds = {"pieces": _Pieces, "byte_bpe": _ByteBpe, "word_bpe": _WordBpe, "library": _Library}
        kept[path] = kinds[_kind(path)](path)
    return kept[path]


def tokenizer_version(path: str) -> str:
    """Digest of a vocabulary file: counts of another file are never reused."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def _count_batches(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column("text")
            counts = [enc.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )
        release_memory()

    return run


def normalised(text, path: str):
    """Content whose token count equals the text's: for the lower-casing, space
    dropping tokenizer, ASCII letters in lower case and runs of common white space
    as one blank, unless a special string may be inside; else the text itself."""
    text = F.coalesce(text, F.lit(""))
    if _kind(path) != "word_bpe":
        return text
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate(F.regexp_replace(text, r"[ \t\n\r]+", " "), upper, low)
    return F.when(F.instr(text, "<|") > 0, text).otherwise(plain)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text, through a cache of counts by content digest.

    Texts with one digest (SHA-256 of the normalised content) are one content. The
    digests missing from the cache at `cache_path` (Parquet of digest, version,
    n_tokens; a new one in the shared folder if None) are encoded, one text each,
    and appended; every row then takes its count from the cache. Returns one row
    per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null text
    counts as empty (0 bytes, 0 tokens); null and repeated ids keep their rows; an
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-counts")
    version = tokenizer_version(tokenizer_path)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(
        base.select(
            "id",
            F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
            F.xxhash64("text").alias("t1"),
            F.unhex(F.sha2(normalised(F.col("text"), tokenizer_path), 256)).alias("digest"),
        ),
        "digests",
    )
    known = _read_cache(spark, cache_path, version)
    # One holder of each missing digest: an id and its text, as ids may be null or repeated.
    wanted = rows.groupBy("digest").agg(F.min(F.struct("id", "t1")).alias("holder"))
    if known is not None:
        wanted = wanted.join(known, "digest", "left_anti")
    wanted = wanted.select("digest", F.col("holder.id").alias("wid"), F.col("holder.t1").alias("wt"))
    own = base.withColumn("t1", F.xxhash64("text"))
    holders = own.join(wanted, own["id"].eqNullSafe(wanted["wid"]) & (own["t1"] == wanted["wt"]))
    holders = holders.select("digest", F.coalesce("text", F.lit("")).alias("text"))
    fresh = holders.mapInArrow(_count_batches(tokenizer_path), "digest binary, n_tokens long")
    fresh.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    # written before it is joined, so that a common digest's rows can be split among tasks
    counts = materialize(_read_cache(spark, cache_path, version).join(rows.select("digest").distinct(), "digest", "left_semi"), "counts")
    return (
        rows.join(counts, "digest")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def _read_cache(spark, path: str, version: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    stored = spark.read.schema("digest binary, n_tokens long, version string").parquet(path)
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
