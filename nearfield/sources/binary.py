"""Readers and writers of binary vector files, as Spark data sources.

Formats (short name): `vecbin` (16-byte header: magic, version, dim, count, then float32 rows), `idbin`
(12-byte header, then unsigned 64-bit ids), `graphbin` (24-byte header, then levels and neighbour lists),
`fvecs` and `ivecs` (each row: int32 length, then float32 or int32 values). All little-endian. Readers open
local or mounted files; vecbin, idbin, fvecs and ivecs are split into ranges of equal-sized rows. Writers leave parts
beside the target, so its folder must be one that driver and executors share (a mount); `collection.write` needs none.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the formats.
VECTOR_MAGIC = 0x30584556
GRAPH_MAGIC = 0x57534E48
ID_MAGIC = 0x00534449
VERSION = 1
MAX_LEVEL = 64

SPLIT_BYTES = 64 << 20


def _header(path: str, fields: int, magic: int) -> tuple[int, ...]:
    with open(path, "rb") as f:
        raw = f.read(4 * fields)
    if len(raw) < 4 * fields:
        raise RuntimeError(f"{path}: shorter than its header")
    values = struct.unpack(f"<{fields}I", raw)
    if values[0] != magic:
        raise RuntimeError(f"{path}: bad magic")
    if values[1] != VERSION:
        raise RuntimeError(f"{path}: unknown version {values[1]}")
    return values[2:]


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class _Ranges(DataSourceReader):
    """Rows of one size, cut into ranges."""

    def __init__(self, path: str):
        self.path = path
        self.skip, self.row_bytes, self.count = self.layout()

    def layout(self) -> tuple[int, int, int]:
        raise NotImplementedError

    def partitions(self) -> list[Rows]:
        step = max(1, SPLIT_BYTES // max(1, self.row_bytes))
        return [Rows(i, min(i + step, self.count)) for i in range(0, self.count, step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // max(1, self.row_bytes))
        with open(self.path, "rb") as f:
            for at in range(part.start, part.stop, step):
                n = min(step, part.stop - at)
                f.seek(self.skip + at * self.row_bytes)
                raw = f.read(n * self.row_bytes)
                if len(raw) < n * self.row_bytes:
                    raise RuntimeError(f"{self.path}: truncated")
                yield self.batch(at, n, raw)

    def batch(self, at: int, n: int, raw: bytes) -> pa.RecordBatch:
        raise NotImplementedError


def _lists(values: np.ndarray, dim: int, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(values).ravel()))


class _VectorReader(_Ranges):
    def layout(self) -> tuple[int, int, int]:
        dim, count = _header(self.path, 4, VECTOR_MAGIC)
        if dim == 0:
            raise RuntimeError(f"{self.path}: dimension 0")
        if os.path.getsize(self.path) < 16 + 4 * dim * count:
            raise RuntimeError(f"{self.path}: truncated")
        return 16, 4 * dim, count

    def batch(self, at: int, n: int, raw: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), _lists(np.frombuffer(raw, "<f4"), self.row_bytes // 4, n)], names=["offset", "embedding"])


class _IdReader(_Ranges):
    def layout(self) -> tuple[int, int, int]:
        (count,) = _header(self.path, 3, ID_MAGIC)
        if os.path.getsize(self.path) < 12 + 8 * count:
            raise RuntimeError(f"{self.path}: truncated")
        return 12, 8, count

    def batch(self, at: int, n: int, raw: bytes) -> pa.RecordBatch:
        ids = np.frombuffer(raw, "<u8")
        if n and ids.max() > 2**63 - 1:
            raise RuntimeError(f"{self.path}: an id lies above 2^63-1")
        return pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array(ids.astype(np.int64))], names=["offset", "user_id"])


class _VecsReader(_Ranges):
    kind = "<f4"

    def layout(self) -> tuple[int, int, int]:
        size = os.path.getsize(self.path)
        if size == 0:
            return 0, 4, 0
        with open(self.path, "rb") as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0]) if size >= 4 else -1
        if dim <= 0 or size % (4 + 4 * dim):
            raise RuntimeError(f"{self.path}: rows differ in length or the file is truncated")
        return 0, 4 + 4 * dim, size // (4 + 4 * dim)

    def batch(self, at: int, n: int, raw: bytes) -> pa.RecordBatch:
        table = np.frombuffer(raw, self.kind).reshape(n, -1)
        if (table[:, 0].view("<i4") != self.row_bytes // 4 - 1).any():
            raise RuntimeError(f"{self.path}: rows differ in length")
        return pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), _lists(table[:, 1:], self.row_bytes // 4 - 1, n)], names=["offset", "embedding"])


class _IvecsReader(_VecsReader):
    kind = "<i4"


class _GraphReader(DataSourceReader):
    """One partition: the format has rows of unequal size and no index."""

    def __init__(self, path: str):
        self.path = path
        self.m, self.top, self.entry, self.count = _header(path, 6, GRAPH_MAGIC)

    def read(self, part: InputPartition) -> Iterator[tuple]:
        raw = np.fromfile(self.path, "<i4", offset=24)
        at = 0

        def take(n: int) -> np.ndarray:
            nonlocal at
            if at + n > len(raw):
                raise RuntimeError(f"{self.path}: truncated")
            at += n
            return raw[at - n : at]

        for node in range(self.count):
            level = int(take(1)[0])
            if not 0 <= level <= MAX_LEVEL:
                raise RuntimeError(f"{self.path}: impossible level {level}")
            links = []
            for layer in range(level + 1):
                n = int(take(1)[0])
                if not 0 <= n <= (2 * self.m + 1 if layer == 0 else self.m):
                    raise RuntimeError(f"{self.path}: impossible neighbour count {n}")
                row = take(n)
                if n and not (0 <= row.min() and row.max() < self.count):
                    raise RuntimeError(f"{self.path}: a neighbour lies outside the graph")
                links.append(row.tolist())
            yield node, level, node == self.entry, links


@dataclass
class Part(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """Each task writes a part beside the target; commit joins them in offset order. The input must come in that order (orderBy('offset'))."""

    def __init__(self, path: str, fields: str):
        self.path, self.fields = path, fields

    def rows(self, rows: Iterator) -> Iterator[bytes]:
        raise NotImplementedError

    def head(self, count: int, dim: int) -> bytes:
        return b""

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        c = TaskContext.get()
        at = f"{self.path}.part-{c.partitionId():06d}-{c.taskAttemptId()}"
        n, dim, rows = 0, -1, iter(rows)
        with open(at, "wb") as f:
            for row in rows:
                body, width = self.row(row)
                if dim not in (-1, width):
                    raise ValueError("rows differ in length")
                dim, n = width, n + 1
                f.write(body)
        with open(f"{at}.count", "w") as f:
            f.write(f"{n} {dim}")
        return Part(at)

    def row(self, row) -> tuple[bytes, int]:
        raise NotImplementedError

    def commit(self, messages: list) -> None:
        parts = sorted((m.path for m in messages if m), key=lambda p: p.rsplit(".part-", 1)[1])
        counts = [tuple(map(int, open(f"{p}.count").read().split())) for p in parts]
        dims = {d for n, d in counts if n}
        if len(dims) > 1:
            raise ValueError("rows differ in length")
        temp = f"{self.path}.tmp"
        with open(temp, "wb") as out:
            out.write(self.head(sum(n for n, _ in counts), next(iter(dims), 0)))
            for p in parts:
                with open(p, "rb") as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
        os.replace(temp, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            for p in (m.path, f"{m.path}.count") if m else ():
                if os.path.exists(p):
                    os.remove(p)


class _VectorWriter(_Writer):
    def head(self, count: int, dim: int) -> bytes:
        return struct.pack("<4I", VECTOR_MAGIC, VERSION, dim, count)

    def row(self, row) -> tuple[bytes, int]:
        return np.asarray(row["embedding"], "<f4").tobytes(), len(row["embedding"])


class _IdWriter(_Writer):
    def head(self, count: int, dim: int) -> bytes:
        return struct.pack("<3I", ID_MAGIC, VERSION, count)

    def row(self, row) -> tuple[bytes, int]:
        return struct.pack("<Q", row["user_id"]), 1


class _FvecsWriter(_Writer):
    kind = "<f4"

    def row(self, row) -> tuple[bytes, int]:
        values = np.asarray(row["embedding"], self.kind)
        return struct.pack("<i", len(values)) + values.tobytes(), len(values)


class _IvecsWriter(_FvecsWriter):
    kind = "<i4"


class _GraphWriter(_Writer):
    """Needs the options m, max_level and entry_point."""

    def __init__(self, path: str, m: int, top: int, entry: int):
        super().__init__(path, "")
        self.m, self.top, self.entry = m, top, entry

    def head(self, count: int, dim: int) -> bytes:
        return struct.pack("<6I", GRAPH_MAGIC, VERSION, self.m, self.top, self.entry, count)

    def row(self, row) -> tuple[bytes, int]:
        body = [row["level"]]
        for layer in row["links"]:
            body += [len(layer), *layer]
        return np.asarray(body, "<i4").tobytes(), 1


class _Source(DataSource):
    kind, fields, reads, writes = "", "", _VectorReader, _VectorWriter

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return self.fields

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reads(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if os.path.exists(path) and not overwrite:
            raise RuntimeError(f"{path} exists")
        return self.writes(path, self.fields)


class VectorBinary(_Source):
    kind, fields, reads, writes = "vecbin", "offset bigint, embedding array<float>", _VectorReader, _VectorWriter


class IdBinary(_Source):
    kind, fields, reads, writes = "idbin", "offset bigint, user_id bigint", _IdReader, _IdWriter


class Fvecs(_Source):
    kind, fields, reads, writes = "fvecs", "offset bigint, embedding array<float>", _VecsReader, _FvecsWriter


class Ivecs(_Source):
    kind, fields, reads, writes = "ivecs", "offset bigint, embedding array<int>", _IvecsReader, _IvecsWriter


class GraphBinary(_Source):
    kind, fields, reads = "graphbin", "offset bigint, level int, entry boolean, links array<array<int>>", _GraphReader

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if os.path.exists(path) and not overwrite:
            raise RuntimeError(f"{path} exists")
        return _GraphWriter(path, *(int(self.options[x]) for x in ("m", "max_level", "entry_point")))


def register(spark: SparkSession) -> None:
    for source in (VectorBinary, IdBinary, Fvecs, Ivecs, GraphBinary):
        spark.dataSource.register(source)
