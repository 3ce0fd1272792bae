"""Content-addressed store of token ids.

Each document's ids, with the end id, are cut into chunks where a rolling hash of the last WINDOW ids has its low
bits clear, between MIN_CHUNK and MAX_CHUNK ids; so equal passages give equal chunks wherever they stand. The store
has three tables below its folder:

  chunks/    digest (BLAKE2b, 16 bytes) and ids (little-endian, two bytes each while all ids fit, else four; zstd): each
             chunk's ids once. Rows with null ids only refer to a chunk
  recipes/   in ascending doc_id order: doc_id, start (ids of all documents before), n_tokens, width, root, digests
  manifest/  one row for each recipe file range: bucket, first and last doc_id, documents, tokens, root

A document's root is the Merkle root over its chunks' digests, a manifest row's root that over its documents'
roots. Reading joins recipes and chunks, checks every chunk's digest, every document's root and, against the manifest,
that each range has all its documents, and fails on a difference. A null or empty text is the end id alone. Null doc_ids come first; equal ones in order of their roots.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import Recent, documents, running_start, scratch

WINDOW, MASK_BITS, MIN_CHUNK, MAX_CHUNK = 16, 9, 128, 4096
#: Words of one generation of a Python worker's cache.
CACHE_WORDS = 500_000


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves; leaves and inner nodes are hashed apart, an odd node goes up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"\0")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_GEAR = np.random.RandomState(7).randint(0, 2**32, size=1 << 16, dtype=np.uint32)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[ids & 0xFFFF]
    step = 1
    while step < WINDOW:  # sums of gear values over 2, 4, .. WINDOW ids, the older ones shifted further
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, at = [], 0
    while n - at > MIN_CHUNK:
        i = np.searchsorted(marks, at + MIN_CHUNK)
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + MAX_CHUNK, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


# Fixed values of the tokenizer's pattern, for words of ASCII and Latin-1 letters, where all Unicode versions agree.
_LETTERS = "a-zà-öø-ÿß"
_PLAIN = re.compile(f"[!-~{_LETTERS.replace('a-z', '')}À-ÖØ-Þ]+")
# Only pieces that begin with an apostrophe overlap, so letters come first: they are found faster.
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^0-9{_LETTERS}]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b) if shown[b] else chr(256 + b - sum(shown[:b])) for b in range(256)]


_LETTER_OF = dict(enumerate(_byte_letters()))


# The normaliser and pattern of the tokenizer that the rules here stand for.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Ids of a word as bytes. Words end at ASCII white space, which no token of the tokenizer crosses.

    Words of plain Latin letters are cut by the tokenizer's pattern here and their pieces given to its model;
    all other words go through the whole tokenizer. A tokenizer with other rules gets whole texts.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        rules = json.loads(tokenizer_json)
        self.model = self.tokenizer.model
        self.by_word = all(rules.get(k) == v for k, v in _RULES.items()) and not rules["model"].get("unk_token")
        self.words, self.pieces = Recent(self.word, CACHE_WORDS), Recent(self.piece, CACHE_WORDS)

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters are one piece
            return self.pieces[word.lower().decode()]
        text = word.decode("utf-8", "replace")
        plain = text.isprintable() if text.isascii() else _PLAIN.fullmatch(text)
        if plain and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():  # printable ASCII stands for itself
            piece = piece.encode().decode("latin-1").translate(_LETTER_OF)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        tail = np.array([end_id], "<u4").tobytes()
        if not self.by_word:
            every = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array([*x.ids, end_id], "<u4") for x in every]
        out = []
        for t in texts:
            out.append(np.frombuffer(b"".join(map(self.words.__getitem__, t.split())) + tail, "<u4"))
            self.words, self.pieces = self.words.turned(), self.pieces.turned()
        return out


_ENCODERS: dict[bytes, Encoder] = {}
CHUNKS = "digest binary, ids binary, n_ids bigint, after bigint, width int, key bigint, doc_id bigint, seq int, n_tokens bigint"


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """A row for each chunk of each document; of a chunk that the task has emitted already only the reference."""
    shared, name = docs.sparkSession.sparkContext.broadcast(tokenizer_json), digest(tokenizer_json.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(shared.value)
        encoder, packer = _ENCODERS[name], zstandard.ZstdCompressor(level=1)
        width = 4 if encoder.tokenizer.get_vocab_size() > 1 << 16 else 2
        key = TaskContext.get().partitionId() << 40
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts, end_id)):
                    start, n, key = 0, len(ids), key + 1
                    for seq, end in enumerate(cuts(ids)):
                        raw = ids[start:end].astype(f"<u{width}").tobytes()
                        d = digest(raw)
                        rows.append((d, None if d in seen else packer.compress(raw), end - start, n - end, width, key, doc_id, seq, n))
                        seen.add(d)
                        start = end
                    if len(seen) > CACHE_WORDS:
                        seen.clear()
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = [c.split()[0] for c in CHUNKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


@F.pandas_udf(T.BinaryType())
def merkle_root(digests: pd.Series) -> pd.Series:
    return pd.Series([merkle(list(d)) for d in digests])


def write_store(docs: DataFrame, out: str, tokenizer_json: str, end_id: int) -> None:
    """Writes the three tables below out."""
    spark = docs.sparkSession
    # References are dealt out apart from contents, so a chunk that many documents hold fills no task.
    salt = F.when(F.col("ids").isNull(), F.pmod(F.xxhash64("key", "seq"), F.lit(1 << 16)) + 1).otherwise(0)
    rows = encoded(docs, tokenizer_json, end_id).withColumn("salt", salt)
    first = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("key", "seq")) == 1
    rows.withColumn("ids", F.when(first, F.col("ids"))).drop("salt").write.option("compression", "zstd").parquet(f"{out}/chunks")
    refs = spark.read.parquet(f"{out}/chunks").select("key", "doc_id", "seq", "digest", "n_tokens", "width")
    listed = F.sort_array(F.collect_list(F.struct("seq", "digest")))
    recipes = refs.groupBy("key", "doc_id", "n_tokens", "width").agg(listed.alias("x")).select("key", "doc_id", "n_tokens", "width", F.col("x.digest").alias("digests"))
    recipes = running_start(recipes.withColumn("root", merkle_root("digests")), ["doc_id", "root", "key"], "n_tokens", "start")
    recipes.select("bucket", "key", "doc_id", "start", "n_tokens", "width", "root", "digests").sortWithinPartitions("bucket", "start", "doc_id").write.option("compression", "zstd").parquet(f"{out}/recipes")

    ranges(spark, out).write.parquet(f"{out}/manifest")


RANGE = "bucket int, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, root binary"


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """A row (RANGE) for each range of the recipes as they are stored."""

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start", "root"])
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "first_id": [part["doc_id"].min()], "last_id": [part["doc_id"].max()], "n_docs": [len(part)], "n_tokens": [part["n_tokens"].sum()], "root": [merkle(list(part["root"]))]})

    recipes = spark.read.schema("bucket int, doc_id bigint, start bigint, n_tokens bigint, root binary").parquet(f"{path}/recipes")
    return recipes.groupBy("bucket").applyInPandas(summary, RANGE)


def verify_ranges(spark: SparkSession, path: str) -> None:
    """RuntimeError unless the recipes are those that the manifest lists."""
    listed = spark.read.schema(RANGE).parquet(f"{path}/manifest").select(F.col("bucket").alias("b"), F.struct("n_docs", "n_tokens", "root").alias("want"))
    found = ranges(spark, path).select("bucket", F.struct("n_docs", "n_tokens", "root").alias("have"))
    wrong = listed.join(found, listed["b"] == found["bucket"], "full").where(~F.col("want").eqNullSafe(F.col("have"))).limit(1).count()
    if wrong:
        raise RuntimeError("the recipes are not those of the manifest")


# CRC-32 of joined parts: each part's CRC is moved on by the bytes that follow it, and all are xored.
_CRC = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, bits reflected."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_CRC), b >> np.uint32(1))
    return out


def shift_crc(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The CRCs as they count in front of so many further bytes."""
    out, power = crc.astype(np.uint32), np.array([1 << 23], np.uint32)  # x^8
    rest = following.astype(np.int64)
    while rest.any():
        odd = (rest & 1).astype(bool)
        out[odd] = _times(np.broadcast_to(power, odd.sum()), out[odd])
        power, rest = _times(power, power), rest >> 1
    return out


@F.pandas_udf(T.LongType())
def shifted(crc: pd.Series, following: pd.Series) -> pd.Series:
    return pd.Series(shift_crc(crc.to_numpy(), following.to_numpy()).astype(np.int64))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(digest, crc, n): each stored chunk, its digest checked, with the CRC of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for d, ids, width in zip(*(batch.column(c).to_pylist() for c in ("digest", "ids", "width"))):
                raw = unpack.decompress(ids)
                if digest(raw) != d:
                    raise RuntimeError("a stored chunk differs from its digest")
                rows.append((d, zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()), len(raw) // width))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "crc", "n"])

    stored = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("digest", "ids", "width")
    return stored.mapInArrow(run, "digest binary, crc bigint, n bigint")


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    """The recipes; reading one whose root does not follow from its digests fails."""
    verify_ranges(spark, path)
    rows = spark.read.parquet(f"{path}/recipes")
    wrong = F.raise_error(F.lit("a recipe differs from its root"))
    return rows.withColumn("root", F.when(merkle_root("digests") == F.col("root"), F.col("root")).otherwise(wrong.cast("binary")))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files, each chunk and root checked; no ids are moved."""
    refs = recipes_of(spark, path).select("key", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("seq", "digest"))
    parts = refs.join(contents(spark, path), "digest", "left")
    after = Window.partitionBy("key").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumn("following", F.coalesce(F.sum("n").over(after), F.lit(0)) * 4)
    parts = parts.withColumn("moved", shifted("crc", "following"))
    each = parts.groupBy("key", "doc_id", "start", "n_tokens", "root").agg(F.bit_xor("moved").alias("ids_crc32"), F.sum("n").alias("found"))
    wrong = F.raise_error(F.lit("a document's chunks are missing")).cast("bigint")
    return each.select("doc_id", "start", F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(wrong).alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, rebuilt from its recipe."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(unpack.decompress(x["ids"]), f"<u{w}") for x in row]).astype(np.int64) for row, w in zip(batch.column("x").to_pylist(), batch.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("digest", "ids")
    refs = recipes_of(spark, path).select("key", "doc_id", "start", "width", F.posexplode("digests").alias("seq", "digest"))
    each = refs.join(chunks, "digest").groupBy("key", "doc_id", "start", "width").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("x"))
    return each.mapInArrow(join, "doc_id bigint, start bigint, ids array<bigint>")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        tokenizer_json = f.read()
    out = scratch(spark, "token-store")
    write_store(documents(spark, sf_dir), out, tokenizer_json, 2)
    return read_summaries(spark, out)
