"""A corpus pipeline: toxicity, exact copies, near copies, source mixing, token ids.

Each stage takes the documents that the one before kept and returns documents again; the last returns token ids.
Between stages the documents are written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from nearfield.llm.common import discard, documents, staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, by a model learned from the labels of what came in."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id."""
    return exact_dedup.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs, words=5, numer=80, denom=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document stands in it as often as it is taken."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids as little-endian unsigned 32-bit integers, and digests of them and of what they decode to."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows, codec = byte_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    ids = F.col("ids")
    n_tokens, decoded = F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(codec.decode(ids), 256).alias("decoded_sha256")
    out = rows.select("doc_id", "lang", "source", n_tokens, codec.binary(ids).alias("raw"), decoded)
    return out.select("doc_id", "lang", "source", "n_tokens", F.col("raw").alias("ids"), "decoded_sha256", F.sha2("raw", 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("source mixing", mixed),
    ("byte-level BPE", token_ids),
]

#: The mix and the token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
