"""Shards of near-equal bytes by histogram sort.

Every row has a 128-bit key: a hash of its text, then a hash of its identifier and its locator (file and row), so equal
texts lie next to each other and repeated rows have keys of their own. Splitters are found by counting, not by sampling: each round counts the exact bytes below candidate
boundaries in all partitions at once and narrows the interval of every splitter, until each is within the
tolerance. A splitter falls inside a group of equal texts only where no boundary between groups is within the
tolerance. Then the rows, texts included, move once; each part is one sorted task.

A null text has no bytes; every row counts 16 bytes more. No rows give no shards' files.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import PLACE, discard, documents, located, scratch, staged

ROW_BYTES = 16
#: Allowed distance of a splitter from its place, as a share of a part.
TOLERANCE = 0.005
#: Candidate boundaries of each splitter in a round, and of all splitters together, which bounds what is broadcast.
PROBES, MOST_PROBES = 32, 1 << 17
#: Bytes above which a shard is sorted by several tasks.
PART_BYTES = 256 << 20
SIGN = 1 << 63
UNIT = 1 << 64
TOP = 1 << 128


def _keys(group: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Keys as 16 big-endian bytes, which compare as numbers."""
    pair = np.empty((len(group), 2), ">u8")
    pair[:, 0] = group.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    pair[:, 1] = tie.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    return pair.view("S16").ravel()


def _probe_keys(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(16, "big") for p in probes], "S16")


def bytes_below(rows: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with a key below each of the sorted probes, and of all rows at the end."""
    shared = rows.sparkSession.sparkContext.broadcast(_probe_keys(probes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        total, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, _keys(b.column("group").to_numpy(), b.column("tie").to_numpy()), "right")
            np.add.at(total, at, b.column("size").to_numpy())
            n += np.bincount(at, minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full]), pa.array(n[full])], names=["at", "bytes", "rows"])

    found = rows.select("group", "tie", "size").mapInArrow(count, "at bigint, bytes bigint, rows bigint").groupBy("at").agg(F.sum("bytes"), F.sum("rows")).collect()
    each = {r[0]: (r[1], r[2]) for r in found}
    table = np.array([each.get(i, (0, 0)) for i in range(len(probes) + 1)], np.int64).cumsum(axis=0)
    return table[:, 0].tolist(), table[:, 1].tolist()


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """parts - 1 keys that split the bytes evenly, and the rows of each part.

    Boundaries are sought between groups first (keys whose lower half is 0), inside a group only where it is too large.
    """
    (total,), (count,) = bytes_below(rows, [])
    slack = total / max(1, parts) * tolerance
    want = [total * j / parts for j in range(1, parts)]
    low, high = [(0, 0, 0)] * len(want), [(TOP, total, count)] * len(want)  # key, bytes and rows below it
    done: list[int | None] = [None] * len(want)
    while None in done:
        probes: set[int] = set()
        each = max(2, min(PROBES, MOST_PROBES // done.count(None)))
        for j in (j for j, d in enumerate(done) if d is None):
            if len(probes) >= MOST_PROBES:
                break  # the others have their turn in a later round
            (a, a_bytes, a_rows), (b, b_bytes, b_rows) = low[j], high[j]
            near = min(low[j], high[j], key=lambda x: abs(x[1] - want[j]))
            unit = 1 if b - a <= UNIT or a % UNIT else UNIT
            inside = (b - 1) // unit - a // unit
            if abs(near[1] - want[j]) <= slack or b_rows - a_rows <= 1 or inside <= 0:
                done[j] = min(near[0], TOP - 1)
                continue
            steps = min(each, inside)
            probes.update((a // unit + max(1, inside * (i + 1) // (steps + 1))) * unit for i in range(steps))
        if not probes:
            break
        tried = sorted(probes)
        below, rows_below = bytes_below(rows, tried)
        for j in (j for j, d in enumerate(done) if d is None):
            i = bisect_right(below, want[j], hi=len(tried)) - 1
            if i >= 0 and tried[i] > low[j][0]:
                low[j] = (tried[i], below[i], rows_below[i])
            i = bisect_left(below, want[j], hi=len(tried))
            if i < len(tried) and tried[i] < high[j][0]:
                high[j] = (tried[i], below[i], rows_below[i])
    keys = sorted(x for x in done if x is not None)
    below = bytes_below(rows, keys)[1]
    return keys, [b - a for a, b in zip([0, *below], below)]


def shard(docs: DataFrame, shards: int, out: str, *, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes all rows of docs, with size, shard and slot, as Parquet below out, a folder for each shard; returns what was written.

    Slots count from 0 without gaps in key order. Columns of docs named like these are overwritten.
    """
    if shards <= 0:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint")
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    docs = located(docs)
    group, tie = F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64("doc_id", *PLACE)
    keys = staged(docs.select(group.alias("group"), tie.alias("tie"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-total // (shards * part_bytes)))  # parts of a shard
    edges, counts = splitters(keys, shards * each, tolerance)
    inside = np.array(counts, np.int64).reshape(-1, each)
    before = (np.cumsum(inside, axis=1) - inside).ravel()
    discard(keys)
    shared = spark.sparkContext.broadcast(_probe_keys(edges))

    @F.pandas_udf("int")
    def part_of(g: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, _keys(g.to_numpy(), t.to_numpy()), "right").astype(np.int32))

    split = docs.select(*names, size.alias("size"), group.alias("_nf_group"), tie.alias("_nf_tie"))
    split = split.withColumn("_nf_part", part_of("_nf_group", "_nf_tie"))
    moved = split.repartitionById(shards * each, F.col("_nf_part")).sortWithinPartitions("_nf_group", "_nf_tie", "doc_id")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    offsets = spark.sparkContext.broadcast(before)

    @F.pandas_udf("bigint")
    def offset_of(part: pd.Series) -> pd.Series:
        return pd.Series(offsets.value[part.to_numpy()])

    placed = moved.select(*names, "size", (F.col("_nf_part") / each).cast("int").alias("shard"), (offset_of("_nf_part") + row).alias("slot"))
    placed.write.partitionBy("shard").parquet(out)
    return spark.read.schema(placed.schema).parquet(out)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shard(documents(spark, sf_dir).select("doc_id", "text"), 40, scratch(spark, "shards"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return files.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
