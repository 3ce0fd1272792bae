"""Binary collections: `segments.json` and, for each segment, a folder `segment_<i>` with vectors.bin, hnsw.bin and ids.bin.

Files are read through Spark, so they may lie in any file system; a segment is read in one task. The writer sends one
segment at a time through the driver and commits by the registry, which is renamed into place last.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import hnsw
from nearfield.operators.graph import Packed
from nearfield.sources.binary import GRAPH_MAGIC, ID_MAGIC, MAX_LEVEL, VECTOR_MAGIC, VERSION
from nearfield.sources.storage import FORMAT_VERSION, NUMBERS, Store

REGISTRY = "segments.json"
FILES = ("vectors.bin", "hnsw.bin", "ids.bin")


def registry(spark: SparkSession, path: str) -> dict:
    """The checked registry; RuntimeError where it is missing or malformed, or where a segment's file is missing."""
    store = Store(spark, path)
    if not store.exists(REGISTRY):
        raise RuntimeError(f"no {REGISTRY} in {path}")
    try:
        found = json.loads(store.read_text(REGISTRY))
    except ValueError as e:
        raise RuntimeError(f"{REGISTRY} is not JSON") from e
    for name in NUMBERS:
        value = found.get(name) if isinstance(found, dict) else None
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**64:
            raise RuntimeError(f"{REGISTRY}: {name} is missing or not an unsigned integer")
    if found["format_version"] != FORMAT_VERSION:
        raise RuntimeError(f"{REGISTRY}: unknown format version {found['format_version']}")
    for i in range(found["segment_count"]):
        for name in FILES:
            if not store.exists(f"segment_{i}", name):
                raise RuntimeError(f"segment_{i}/{name} is missing")
    return found


def _fields(raw: bytes, fields: int, magic: int, name: str) -> tuple[int, ...]:
    if len(raw) < 4 * fields:
        raise RuntimeError(f"{name}: shorter than its header")
    values = struct.unpack_from(f"<{fields}I", raw)
    if values[0] != magic:
        raise RuntimeError(f"{name}: bad magic")
    if values[1] != VERSION:
        raise RuntimeError(f"{name}: unknown version {values[1]}")
    return values[2:]


def _graph(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """m, entry, levels, degrees and links of a graph file."""
    m, _, entry, count = _fields(raw, 6, GRAPH_MAGIC, "hnsw.bin")
    body = np.frombuffer(raw, "<i4", (len(raw) - 24) // 4, 24)
    levels, degrees, links, at = np.zeros(count, np.int32), [], [], 0
    for node in range(count):
        if at >= len(body):
            raise RuntimeError("hnsw.bin: truncated")
        levels[node], at = body[at], at + 1
        if not 0 <= levels[node] <= MAX_LEVEL:
            raise RuntimeError(f"hnsw.bin: impossible level {levels[node]}")
        for layer in range(levels[node] + 1):
            n = int(body[at]) if at < len(body) else -1
            if not 0 <= n <= (2 * m + 1 if layer == 0 else m):
                raise RuntimeError("hnsw.bin: truncated" if at >= len(body) else f"hnsw.bin: impossible neighbour count {n}")
            degrees.append(n)
            links.append(body[at + 1 : at + 1 + n])
            at += 1 + n
    if at > len(body):
        raise RuntimeError("hnsw.bin: truncated")
    return m, entry, levels, np.array(degrees, np.int32), np.concatenate(links) if links else np.zeros(0, np.int32)


def parsed(segment_id: int, files: dict[str, bytes], dim: int) -> dict:
    """A segment's row; RuntimeError where its files are damaged or do not belong together."""
    width, count = _fields(files["vectors.bin"], 4, VECTOR_MAGIC, "vectors.bin")
    if width != dim:
        raise RuntimeError(f"segment_{segment_id}: dimension {width}, the registry says {dim}")
    if len(files["vectors.bin"]) < 16 + 4 * width * count:
        raise RuntimeError("vectors.bin: truncated")
    (n_ids,) = _fields(files["ids.bin"], 3, ID_MAGIC, "ids.bin")
    if len(files["ids.bin"]) < 12 + 8 * n_ids:
        raise RuntimeError("ids.bin: truncated")
    ids = np.frombuffer(files["ids.bin"], "<u8", n_ids, 12)
    if n_ids and ids.max() > 2**63 - 1:
        raise RuntimeError("ids.bin: an id lies above 2^63-1")
    m, entry, levels, degrees, links = _graph(files["hnsw.bin"])
    if not len(levels) == n_ids == count:
        raise RuntimeError(f"segment_{segment_id}: {count} vectors, {len(levels)} nodes, {n_ids} ids")
    vectors = np.frombuffer(files["vectors.bin"], "<f4", width * count, 16).reshape(count, width)
    try:
        g = Packed(vectors, levels, degrees, links, entry if count else -1, m).check()
    except ValueError as e:
        raise RuntimeError(f"hnsw.bin: {e}") from e
    return hnsw.packed_row(segment_id, ids.astype(np.int64), g)


def read(spark: SparkSession, path: str, head: dict) -> DataFrame:
    """The segments (hnsw.SEGMENTS) of a binary collection."""
    if not head["segment_count"]:
        return spark.createDataFrame([], hnsw.SEGMENTS)
    names = [f"{path.rstrip('/')}/segment_{i}/{name}" for i in range(head["segment_count"]) for name in FILES]
    files = spark.read.format("binaryFile").load(names)
    part = lambda i: F.regexp_extract("path", r"segment_(\d+)/([^/]+)$", i)
    dim = head["dim"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([parsed(int(rows["segment_id"].iloc[0]), dict(zip(rows["name"], rows["content"])), dim)])

    named = files.select(part(1).cast("bigint").alias("segment_id"), part(2).alias("name"), "content")
    return named.groupBy("segment_id").applyInPandas(one, hnsw.SEGMENTS)


def files_of(row: dict) -> dict[str, bytes]:
    """The three files of a segment's row."""
    user, g = hnsw.opened(row)
    body: list[int] = []
    for level, layers in zip(g.levels.tolist(), g.rows()):
        body.append(level)
        for layer in layers:
            body += [len(layer), *layer]
    top = int(g.levels.max()) if row["n"] else 0
    graph = struct.pack("<6I", GRAPH_MAGIC, VERSION, g.m, top, max(g.entry, 0), row["n"]) + np.array(body, "<i4").tobytes()
    return {
        "vectors.bin": struct.pack("<4I", VECTOR_MAGIC, VERSION, row["dim"], row["n"]) + bytes(row["vectors"]),
        "hnsw.bin": graph,
        "ids.bin": struct.pack("<3I", ID_MAGIC, VERSION, row["n"]) + bytes(row["user_ids"]),
    }


def write(segments: DataFrame, path: str, head: dict) -> None:
    """Writes the segments and, last, the registry, which must not exist."""
    store = Store(segments.sparkSession, path)
    if store.exists(REGISTRY):
        raise RuntimeError(f"{path} holds a collection already")
    for row in segments.toLocalIterator():  # one segment at a time
        row = row.asDict()
        for name, raw in files_of(row).items():
            store.write_bytes(raw, f"segment_{row['segment_id']}", name)
    store.replace(json.dumps({k: head[k] for k in NUMBERS}, indent=2).encode(), REGISTRY)
