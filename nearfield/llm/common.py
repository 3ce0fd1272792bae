"""What several operators share: the shared folder, staged tables, word hashes and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from nearfield.sources.shared import discard, scratch, staged  # noqa: F401

#: ASCII white space, as a regular expression of Java and of DuckDB.
SPACE = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: Where a row lies: its file and its number in it.
PLACE = ["_nf_file", "_nf_row"]


def located(docs: DataFrame) -> DataFrame:
    """The rows with their locator; rows that come from no file are staged first."""
    if set(PLACE) <= set(docs.columns):
        return docs
    place = [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return staged(docs, "content").select("*", *place)


def running_start(rows: DataFrame, order: list[str], value: str, name: str, *, rows_each: int = 50_000) -> DataFrame:
    """Adds bucket (ranges of the order) and the sum of value over all rows before, in ascending order.

    Only one sum for each range meets in one place; ranges hold about rows_each rows.
    """
    spark = rows.sparkSession
    rows = staged(rows, "unordered")
    n = max(1, -(-rows.count() // rows_each))
    ranged = staged(rows.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()), "ordered")
    sums = ranged.groupBy("bucket").agg(F.sum(value).alias("_nf_sum")).collect()  # a row for each range
    before, total = [], 0
    for bucket, here in sorted(sums):
        before.append((bucket, total))
        total += here
    offsets = spark.createDataFrame(before, "bucket int, _nf_before bigint")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_nf_inside", inside).join(F.broadcast(offsets), "bucket").withColumn(name, F.col("_nf_inside") + F.col("_nf_before")).drop("_nf_inside", "_nf_before")


def most_frequent(sums: DataFrame, count: str, size: int) -> DataFrame:
    """The rows with the largest counts, at most size of them: all above a level that a histogram of the counts gives."""
    at = F.floor(F.log2(count) * 8)
    total, least = 0, None
    for level, n in sums.groupBy(at.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        if total + n > size:
            break
        total, least = total + n, level
    return sums.where(F.lit(False) if least is None else at >= least)


#: Per cent of the driver's heap that may stay free after a full collection, at least and at most; Java's own are 40 and 70.
FREE_HEAP = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "20"}


def lean_heap(spark: SparkSession) -> None:
    """Lets a full collection of the driver's JVM hand back all of the heap but FREE_HEAP; a JVM without these options stays as it is."""
    context = spark.sparkContext
    java = context._jvm.java.lang
    try:
        kind = java.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = java.management.ManagementFactory.getPlatformMXBean(kind)
        put = next(m for m in kind.getMethods() if m.getName() == "setVMOption")
        for name, value in FREE_HEAP.items():
            both = context._gateway.new_array(java.Object, 2)
            both[0], both[1] = name, value
            put.invoke(options, both)  # the bean's own class is not open to other modules
    except Py4JJavaError:
        pass


def give_back(spark: SparkSession) -> None:
    """Hands freed memory of the driver, of this process and of its JVM, back to the system, where they can.

    A JVM keeps what its heap once grew to, up to the limit, until a full collection; between many small queries there is none.
    """
    gc.collect()  # first, so that the JVM's objects that only this process named are free
    lean_heap(spark)
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Recent(dict):
    """A cache of two bounded generations: what was not asked for since the last turn is made anew."""

    def __init__(self, make: Callable, limit: int, old: dict | None = None):
        super().__init__()
        self.make, self.limit, self.old = make, limit, old or {}

    def __missing__(self, key):
        value = dict.get(self.old, key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turned(self) -> "Recent":
        """This cache, or the next generation once it is full."""
        if len(self) <= self.limit:
            return self
        self.old = {}
        return Recent(self.make, self.limit, self)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(separators: np.ndarray) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]  # A-Z count as a-z
    values[separators] = 0
    return values


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words of letters and digits: everything else of ASCII separates.
_IS_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TABLES = {"space": (_IS_SPACE, _byte_values(_IS_SPACE)), "other": (_IS_OTHER, _byte_values(_IS_OTHER))}
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
#: Bytes hashed at once.
BLOCK = 1 << 20


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) * 2, _STEP)]))
    return _POWERS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, split: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, A-Z as a-z, and the n + 1 offsets of the texts' words.

    Works in blocks of about a megabyte, cut between words, so memory does not grow with a text.
    """
    is_space, values = _TABLES[split]
    hashes, firsts = [], []
    texts = offsets[:-1][np.diff(offsets) > 0]
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            stop = np.searchsorted(texts, end, "right") - 1
            cut = int(texts[stop]) if stop >= 0 and texts[stop] > at else at
            gaps = np.flatnonzero(is_space[data[max(cut, end - 65536) : end]])
            if len(gaps):
                cut = max(cut, end - 65536) + int(gaps[-1]) + 1
            if cut <= at:  # one word fills the block: go on to its end
                rest = np.flatnonzero(is_space[data[end:]])
                limit = texts[np.searchsorted(texts, end, "left")] if np.searchsorted(texts, end, "left") < len(texts) else len(data)
                cut = min(int(limit), end + int(rest[0]) + 1 if len(rest) else len(data))
            end = cut
        part = data[at:end]
        solid = ~is_space[part]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = texts[np.searchsorted(texts, at) : np.searchsorted(texts, end)] - at
        begins[inner] = solid[inner]
        start = np.flatnonzero(begins)
        if len(start):
            length = np.diff(np.append(start, len(part)))
            place = np.arange(start[0], len(part)) - np.repeat(start, length)
            cell = values[part[start[0] :]] * _powers(int(length.max()) + 1)[place]
            solids = np.add.reduceat(solid[start[0] :].astype(np.int64), start - start[0])
            total = np.add.reduceat(cell, start - start[0])
            hashes.append(mix(total + mix(solids.astype(np.uint64))))
            firsts.append(start + at)
        at = end
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(first, offsets)


def pieces_of(batch: pa.RecordBatch, most: int = 8 << 20):
    """The batch in slices of whole rows with about that many bytes of text each."""
    sizes = batch.column("text")
    _, offsets = text_bytes(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over (a, b). Each round takes the least label around and then its label; rounds are staged."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = new.join(jump, new.label == jump.via, "left").select("node", F.least("label", "further").alias("label"), "old")
        new = staged(new, "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").limit(1).count() == 0:
            return labels
