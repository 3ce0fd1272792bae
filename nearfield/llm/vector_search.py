"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are cut into pairs of dimensions; each pair has 16 centroids, so a vector is four bits a pair, two pairs a
byte. Codebooks are trained on a bounded sample to a loss that weighs the residual parallel to the vector ETA times
the residual orthogonal to it, since only the parallel part moves large inner products; every vector's code is then
improved pair by pair under the same loss. The codes are stored once, beside the vectors. A scan adds up table entries,
one lookup for each byte of code; the RERANK rows of each task and query with the largest sums (ties to the smaller id)
are scored exactly, in double precision, on the original vectors, and the best k of them go on. So a task's answer does
not depend on how its rows come in batches.

Vectors that are null, zero or hold null or non-finite values take no part. Vectors of each dimension are searched among
themselves, as there is no inner product of different ones. Ties go to the smaller id; repeated rows count as one row
each, but one row of the query's id and vector, the query itself, is left out. Queries of one id are one query. They run
in blocks, so that no broadcast grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import staged

#: Rows that the codebooks are fitted on: those with the smallest hash of their id.
SAMPLE = 8192
ETA = 3.0
RERANK = 120
QUERY_BLOCK, VECTOR_BLOCK = 8192, 4096
#: Queries whose tables of sums are in memory at once.
TABLES = 256
ROUNDS = 8
STRIDE, K = 20, 20


@dataclass(frozen=True)
class Codebook:
    centroids: np.ndarray  # pairs, 16, 2
    dim: int

    @property
    def pairs(self) -> int:
        return len(self.centroids)


def _paired(x: np.ndarray) -> np.ndarray:
    """[rows, pairs, 2], the last dimension filled up with 0; an even number of pairs."""
    width = -(-x.shape[1] // 4) * 4
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, 2)


def assign(x: np.ndarray, centroids: np.ndarray, eta: float = ETA, rounds: int = 2) -> np.ndarray:
    """Codes [rows, pairs] by coordinate descent on |r|^2 + (eta - 1) (r . u)^2, r the residual, u the vector's direction."""
    p = _paired(x)
    u = p / np.linalg.norm(x, axis=1)[:, None, None]
    far = ((p[:, :, None, :] - centroids[None]) ** 2).sum(-1)  # rows, pairs, 16
    along = (p * u).sum(-1)[:, :, None] - np.einsum("npd,pcd->npc", u, centroids)  # parallel part of each choice
    codes = far.argmin(-1)
    parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = parallel.sum(1)
    rows = np.arange(len(x))
    for _ in range(rounds):
        for j in range(p.shape[1]):
            rest = total - parallel[:, j]
            best = (far[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            codes[:, j], parallel[:, j] = best, along[rows, j, best]
            total = rest + parallel[:, j]
    return codes.astype(np.uint8)


def train(sample: np.ndarray, eta: float = ETA, rounds: int = ROUNDS) -> Codebook:
    """Alternates codes and centroids; a centroid solves the weighted least squares of its members, the other pairs held."""
    x = np.asarray(sample, np.float64)
    p = _paired(x)
    u = p / np.linalg.norm(x, axis=1)[:, None, None]
    rng = np.random.RandomState(11)
    centroids = np.stack([p[rng.choice(len(x), 16, replace=len(x) < 16), j] for j in range(p.shape[1])])
    for _ in range(rounds):
        codes = assign(x, centroids, eta, 1)
        for j in range(p.shape[1]):
            decoded = centroids[np.arange(p.shape[1]), codes]
            parallel = ((p - decoded) * u).sum(-1)
            rest = parallel.sum(1) - parallel[:, j]
            uj = u[:, j]
            weight = np.eye(2)[None] + (eta - 1) * uj[:, :, None] * uj[:, None, :]
            aim = np.einsum("nab,nb->na", weight, p[:, j]) + (eta - 1) * rest[:, None] * uj
            for c in range(16):
                mine = codes[:, j] == c
                if mine.any():
                    centroids[j, c] = np.linalg.lstsq(weight[mine].sum(0), aim[mine].sum(0), rcond=None)[0]
    return Codebook(centroids, x.shape[1])


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def tables(queries: np.ndarray, book: Codebook) -> np.ndarray:
    """[queries, bytes of a code, 256]: what each byte adds to the score."""
    part = np.einsum("qpd,pcd->qpc", _paired(queries), book.centroids)
    low, high = part[:, ::2], part[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part, as (vec_id, embedding double[])."""
    v = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Codebook:
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    return train(np.array([r["embedding"] for r in chosen]))


FOUND = "query_id bigint, vec_id bigint, score double, own boolean"


def encoded(rows: DataFrame, book, dim: int) -> DataFrame:
    """(vec_id, embedding, code) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                code = pack(assign(matrix(part.column("embedding"), dim), book.value.centroids))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "embedding", "code"])

    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, code binary")


def search(rows: DataFrame, queries: DataFrame, k: int, *, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, embedding) among all rows but itself."""
    spark = rows.sparkSession
    rows, queries = usable(rows), usable(queries).dropDuplicates(["vec_id"])
    found = None
    for dim in sorted(r[0] for r in queries.select(F.size("embedding")).distinct().collect()):
        here = rows.where(F.size("embedding") == dim)
        book = spark.sparkContext.broadcast(fit(here, sample))
        codes = staged(encoded(here, book, dim), "codes")
        for ids, block in _blocks(queries.where(F.size("embedding") == dim), QUERY_BLOCK):
            near = _scan(codes, ids, block, book, dim, k + 1, max(k + 1, rerank))
            found = near if found is None else found.unionAll(near)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # One of the rows that are the query goes; it is among the first k + 1 or not among the k at all.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    first = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    itself = F.min(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("query_id"))
    first = first.withColumn("itself", F.coalesce(itself, F.lit(k + 2))).where(F.col("at") != F.col("itself"))
    rank = (F.col("at") - (F.col("at") > F.col("itself")).cast("int")).alias("rank")
    return first.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows)


def _scan(codes: DataFrame, ids: np.ndarray, block: np.ndarray, book, dim: int, k: int, rerank: int) -> DataFrame:
    """One block of queries (a bounded broadcast) against all rows; each task keeps k of each query, of the rerank best by code."""
    shared = codes.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        # Of each query the best rows so far: sums, ids, exact scores, whether it is the query.
        best = [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))] * len(qid)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                vid, v = part.column("vec_id").to_numpy(), matrix(part.column("embedding"), dim)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(vid), -1).T.copy()  # a row for each byte
                for first in range(0, len(qid), TABLES):
                    luts = tables(q[first : first + TABLES], book.value)
                    for i, lut in enumerate(luts, first):
                        near = lut[0].take(code[0])
                        for j in range(1, len(code)):
                            near += lut[j].take(code[j])
                        sums, known, exact, own = best[i]
                        top = np.flatnonzero(near >= (sums[-1] if len(sums) == rerank else -np.inf))
                        if len(top) > rerank:
                            edge = np.partition(near[top], len(top) - rerank)[len(top) - rerank]
                            top = top[near[top] >= edge]
                        if not len(top):
                            continue
                        scores = np.cumsum(v[top] * q[i], axis=1)[:, -1]  # added left to right
                        same = (vid[top] == qid[i]) & (v[top] == q[i]).all(axis=1)
                        every = [np.append(a, b) for a, b in zip((sums, known, exact, own), (near[top], vid[top], scores, same))]
                        keep = np.lexsort((every[1], -every[0]))[:rerank]
                        best[i] = tuple(x[keep] for x in every)
        for first in range(0, len(qid), TABLES):
            out = []
            for i in range(first, min(first + TABLES, len(qid))):
                _, known, exact, own = best[i]
                keep = np.lexsort((~own, known, -exact))[:k]
                out.append((np.full(len(keep), qid[i]), known[keep], exact[keep], own[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score", "own"])

    return codes.mapInArrow(run, FOUND)


def op8_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % STRIDE == 0), K)
