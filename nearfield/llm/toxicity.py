"""Toxicity by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words (runs of letters and digits, A-Z as a-z), of its
adjacent pairs and of its pairs one word apart, each in its own part of the hash space. FTRL-proximal keeps a
learning rate for each coordinate and sets to 0 what L1 does not let through, so the weights that go to the
executors are few. Texts are scored whole, in blocks of bounded memory.

The model is fitted on the driver, on a bounded sample of labelled rows: of the TRAIN_ROWS labelled identifiers with the
smallest hash, leaving out held-out ones, those whose texts together keep within TRAIN_BYTES, taken in hash order. A text
without features scores by the bias alone. Without labels (or with one class only) every score is 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import documents, give_back, hash_words, mix, pieces_of, text_bytes

#: Bits of the hash space of words, and of those of pairs and of skip-pairs.
WORD_BITS, PAIR_BITS = 21, 20
SPACE_SIZE = (1 << WORD_BITS) + (2 << PAIR_BITS)
TRAIN_ROWS = 12_000
TRAIN_BYTES = 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0
#: How many times the penalty of a word a pair's is: there are many more of them.
PAIR_PENALTY = 2.0
PAIR, SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Model:
    """Non-zero weights by feature, and the bias; None where nothing could be learned."""

    at: np.ndarray
    weight: np.ndarray
    bias: float | None

    def dense(self) -> np.ndarray:
        out = np.zeros(SPACE_SIZE, np.float32)
        out[self.at] = self.weight
        return out


def held_out(doc_id: Column, folds: int) -> Column:
    """Remainder of the crc32 of doc_id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def features(words: np.ndarray) -> np.ndarray:
    """Distinct features of one text's word hashes."""
    kinds = [words >> np.uint64(64 - WORD_BITS)]
    if len(words) > 1:
        kinds.append((mix(words[:-1] * PAIR + words[1:]) >> np.uint64(64 - PAIR_BITS)) + np.uint64(1 << WORD_BITS))
    if len(words) > 2:
        kinds.append((mix(words[:-2] * SKIP + words[2:]) >> np.uint64(64 - PAIR_BITS)) + np.uint64((1 << WORD_BITS) + (1 << PAIR_BITS)))
    return np.unique(np.concatenate(kinds)).astype(np.int64)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in pieces_of(batch):
            data, offsets = text_bytes(part.column("text"))
            words, first = hash_words(data, offsets, "other")
            yield part, [features(words[a:b]) for a, b in zip(first[:-1], first[1:])]


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, folds: int = 5) -> Model:
    """The model learned from labels (doc_id, toxic) of rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (held_out(F.col("doc_id"), folds) != 0))
    chosen = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    # A bounded number of ids and labels goes to every task, and one sum for each comes back.
    texts = docs.select("doc_id", "text")
    sizes = texts.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).join(F.broadcast(chosen), "doc_id")
    sums = sizes.groupBy("doc_id", "toxic").agg(F.sum("size").alias("size")).collect()
    room, picked = most_bytes, []
    for r in sorted(sums, key=lambda r: (int(mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0]), r["toxic"])):
        if r["size"] <= room:
            room -= r["size"]
            picked.append((r["doc_id"], r["toxic"]))
    sample = texts.join(F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id bigint, toxic int")), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for part, rows_ in featured(batches):
            packed = [packer.compress(np.diff(r, prepend=0).astype(np.int32).tobytes()) for r in rows_]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "features"])

    place = {x: i for i, x in enumerate(picked)}
    give_back(docs.sparkSession)  # what ran before may have left a grown heap
    found = [(place[r[0], r[1]], int(r[1] != 0), bytes(r[2])) for r in sample.mapInArrow(extract, "doc_id bigint, toxic int, features binary").toLocalIterator()]
    found.sort()
    give_back(docs.sparkSession)  # before the arrays of the fit
    model = train(Packed([x for _, _, x in found]), np.array([float(y) for _, y, _ in found]))
    del found
    give_back(docs.sparkSession)
    return model


class Packed(Sequence):
    """The features of each text, held compressed and unpacked whenever they are asked for."""

    def __init__(self, rows: list[bytes]):
        self.rows, self.unpack = rows, zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(self.rows[i]), np.int32).cumsum(dtype=np.int32)


def train(rows: Sequence[np.ndarray], y: np.ndarray, *, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> Model:
    if len(rows) == 0 or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    size = SPACE_SIZE
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
    balance = {1.0: 0.5 / y.mean(), 0.0: 0.5 / (1 - y.mean())}  # both classes weigh the same

    def weights(at: np.ndarray) -> np.ndarray:
        zz, penalty = z[at], np.where(at < 1 << WORD_BITS, l1, np.where(at < size, l1 * PAIR_PENALTY, 0.0))
        w = -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) > penalty, w, 0.0)

    for _ in range(epochs):
        for row, label in zip(rows, y):
            at = np.append(row, size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * balance[label]
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    touched = np.flatnonzero(n[:size])
    parts = [(at, weights(at)) for at in np.array_split(touched, max(1, len(touched) >> 18))]
    at, weight = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    return Model(at[weight != 0], weight[weight != 0], float(weights(np.array([size]))[0]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of docs but text, and the score; a clashing column is overwritten."""
    names = [c for c in docs.columns if c not in ("text", name)]
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {kinds[c].simpleString()}" for c in names), f"{name} double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = m.dense()
        for part, rows in featured(batches):
            total = np.array([dense[r].sum(dtype=np.float64) for r in rows]) + (m.bias or 0.0)
            p = np.zeros(len(rows)) if m.bias is None else 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p)], names=[*names, name])

    return docs.select(*names, "text").mapInArrow(run, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The documents that the model does not reject, with their columns."""
    model = fit(docs, labels)
    rows = docs.withColumn("_nf_text", F.col("text"))
    kept = score(rows, model, "_nf_score").where(F.col("_nf_score") < threshold)
    return kept.select(*(F.col("_nf_text").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (held_out(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
