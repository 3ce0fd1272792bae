"""Exact Jaccard self-join of documents on word n-grams, down to connected components.

A document's set holds the 64-bit hashes of its distinct n-word shingles, A-Z as a-z (fewer words: the whole
sequence; no words: the empty set, linked with nothing). Two documents link when their sets' Jaccard similarity is
at least numer / denom. Rows of a null doc_id link with nothing; rows of one doc_id count as one node.

1. Order. The shingles of all sets are counted in a table of 2**CELL_BITS cells; shingles come in the order of their
   cell's level, then of their hashes. Any order gives the same links; this one keeps common passages, also those that
   repeat only across blocks, out of the prefixes.
2. Index. By the prefix principle, similar sets share a shingle among the first n - ceil(t n) + 1. Those are packed
   into buckets of index lists. Equal sets are one class; of the HEAVY classes with the most documents only the first
   document is indexed, of others one for each task. Lists skip whole blocks of entries whose least position already
   fails the bound on the overlap that a shared shingle at two positions leaves (index-level skipping).
3. Answers. Of a long list's pairs only those of a leader and its members are verified first, one for each member. For two
   members y, z of a leader x, the overlap is at most min(|xy|, |xz|) + min(|y| - |xy|, |z| - |xz|): so their answers follow from the
   leader's (answer-level skipping). What this bound allows and no chain of links connects yet must also pass a bound
   from sketches: a set's sketch holds, for each place, whether an odd number of its shingles fall there, so two sketches
   differ in at most as many places as the sets do (lists hold sketches of SMALL_PLACES at most; whole ones are asked
   before a verification). Of what is left, each entry of a list first hands on the pair with the sketch most like its own,
   then each two components one pair, then all pairs still left; after each, what was handed on is verified and components
   merged. Lists of more than WHOLE entries are dealt out by bands of set sizes. Every link between documents of different
   components is thus found; pairs within a component are not enumerated.
4. Verification ships each needed set once for each pair and compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import components, discard, documents, give_back, hash_words, mix, most_frequent, pieces_of, staged, text_bytes

WORDS, NUMER, DENOM = 4, 85, 100
#: Bits of a shingle that name its cell in the table of counts, and of those the bits that name the cell's range.
CELL_BITS, RANGE_BITS = 24, 8
#: Shingles counted together in a task.
COUNT_BLOCK = 1 << 20
#: Index entries of a bucket.
BUCKET_ENTRIES = 200_000
#: Lists up to this length give all their pairs at once.
SHORT = 4
SKIP_BLOCK = 64
#: Lists up to this length are dealt out whole, many to a task; longer ones by bands of set sizes.
WHOLE = 4096
#: Entries of lists taken together in a task.
DEAL_ENTRIES = 20_000
#: Pairs of a list, or words of sketches, compared at once.
CHUNK = 1 << 18
#: Places of the sketches that go to the lists.
SMALL_PLACES = 2048
#: Rounds in which each component verifies one pair.
ROUNDS = 2
#: Classes of equal sets that are sent to every task.
HEAVY = 1 << 14
#: Documents whose ids are sent to every task; beyond, texts are joined by shuffle.
BROADCAST_IDS = 200_000
_ROLL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(batches: Iterator[pa.RecordBatch], words: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, for slices of about that many bytes of text."""
    roll = mix(np.arange(1, words + 1, dtype=np.uint64) * _ROLL[0]) | np.uint64(1)
    for batch in batches:
        for part in pieces_of(batch, most):
            data, offsets = text_bytes(part.column("text"))
            h, first = hash_words(data, offsets)
            sets = []
            if len(h) >= words:
                every = h[: len(h) - words + 1] * roll[0]
                for j in range(1, words):
                    every = every + h[j : len(h) - words + 1 + j] * roll[j]
                every = mix(every)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= words:
                    sets.append(np.unique(every[a : b - words + 1]))
                elif b > a:
                    sets.append(mix((h[a:b] * roll[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
                else:
                    sets.append(np.zeros(0, np.uint64))
            yield part, sets


def least_overlap(a: np.ndarray, b: np.ndarray, numer: int, denom: int) -> np.ndarray:
    """Smallest overlap with which sets of these sizes link."""
    return -(-(numer * (a + b)) // (numer + denom))


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def sketch(s: np.ndarray, most: int = 1 << 62) -> bytes:
    """Parities of the numbers of shingles by their low bits: at least 64 places, and twice as many as shingles unless that is over most."""
    places = 64
    while places < min(most, 2 * len(s)):
        places *= 2
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def packed_cells(cell: np.ndarray) -> np.ndarray:
    """Sorted numbers as gaps of a byte each; 255 goes on without a number."""
    gap = np.diff(cell, prepend=0)
    far = gap // 255
    out = np.full(len(gap) + int(far.sum()), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = gap % 255
    return out


def unpacked_cells(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def describe(docs: DataFrame, words: int) -> DataFrame:
    """Two kinds of rows: of each document its set's size, digest and sketches (kind 0), and the cells of all shingles of a block of texts, by range (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def counted() -> Iterator[pa.RecordBatch]:
            if n:
                cell = np.sort(np.concatenate(held))
                edge = np.searchsorted(cell, (np.arange((1 << RANGE_BITS) + 1) << (CELL_BITS - RANGE_BITS)).astype(np.uint32))
                full = np.flatnonzero(np.diff(edge))
                raw = [packed_cells(cell[edge[i] : edge[i + 1]].astype(np.int64) - (i << (CELL_BITS - RANGE_BITS))).tobytes() for i in full]
                none = np.zeros(len(full), np.int64)
                yield _batch("kind doc_id n a b sketch small", np.ones(len(full), np.int32), pa.nulls(len(full), pa.int64()), none, full.astype(np.int64), none, pa.array(raw, pa.binary()), pa.nulls(len(full), pa.binary()))

        for part, sets in shingle_sets(batches, words, 2 << 20):
            size = np.array([len(s) for s in sets], np.int64)
            a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            b = np.array([second_digest(s) for s in sets], np.uint64).view(np.int64)
            both = (pa.array([sketch(s, most) for s in sets], pa.binary()) for most in (1 << 62, SMALL_PLACES))
            yield _batch("kind doc_id n a b sketch small", np.zeros(len(sets), np.int32), part.column("doc_id"), size, a, b, *both)
            held += [(s >> np.uint64(64 - CELL_BITS)).astype(np.uint32) for s in sets]
            n += int(size.sum())
            if n >= COUNT_BLOCK:
                yield from counted()
                held, n = [], 0
        yield from counted()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id bigint, n bigint, a bigint, b bigint, sketch binary, small binary")


def second_digest(s: np.ndarray) -> np.uint64:
    return mix(s ^ _ROLL[1]).sum(dtype=np.uint64)


def global_order(cells: DataFrame) -> np.ndarray:
    """The level of each cell from (a: range, sketch: packed cells): 8 times the logarithm of how many sets' shingles fall there."""
    width = 1 << (CELL_BITS - RANGE_BITS)

    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(width, np.int64)
        for raw in table.column("sketch").to_pylist():
            count += np.bincount(unpacked_cells(raw), minlength=width)
        level = np.minimum(255, 8 * np.log2(np.maximum(count, 1))).astype(np.uint8)
        return pa.table({"a": table.column("a")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    levels = np.zeros((1 << RANGE_BITS, width), np.uint8)
    found = cells.groupBy("a").applyInArrow(run, "a bigint, level binary").toArrow()  # a row for each range
    for at, raw in zip(found.column("a").to_pylist(), found.column("level").to_pylist()):
        levels[at] = np.frombuffer(raw, np.uint8)
    return levels.ravel()


def index_entries(docs: DataFrame, levels: np.ndarray, heavy: dict, buckets: int, words: int, numer: int, denom: int) -> DataFrame:
    """Packed entries (token, doc_id, set size, position) of every set's prefix, by bucket.

    heavy: the first document of each large class by its two digests and size. A task emits other equal sets once for
    each block of texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((levels, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, first_of = shared.value
        seen: set[bytes] = set()
        for part, sets in shingle_sets(batches, words):
            tokens, ids, sizes, places = [], [], [], []
            for doc_id, s in zip(part.column("doc_id").to_pylist(), sets):
                n = len(s)
                if n == 0 or doc_id is None:
                    continue
                many = first_of.get(int(s.sum(dtype=np.uint64)))
                if many is not None and doc_id != many.get((n, int(second_digest(s))), doc_id):
                    continue
                head = s.tobytes() if n < 4 else s[[0, 1, n // 2, -1]].tobytes() + bytes(str((n, int(s.sum(dtype=np.uint64)))), "ascii")
                if head in seen:
                    continue
                seen.add(head)
                level = levels[s >> np.uint64(64 - CELL_BITS)]
                s = s[np.argsort(level, kind="stable")]  # sets are sorted: equal levels stay in the order of hashes
                s = s[: n - -(-numer * n // denom) + 1]
                tokens.append(s)
                ids.append(np.full(len(s), doc_id, np.int64))
                sizes.append(np.full(len(s), n, np.int32))
                places.append(np.arange(len(s), dtype=np.int32))
            if len(seen) > 100_000:
                seen.clear()
            if tokens:
                token, doc, size, place = map(np.concatenate, (tokens, ids, sizes, places))
                bucket = (token >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                cut = lambda x: [x[by[edge[i] : edge[i + 1]]].tobytes() for i in full]
                yield _batch("bucket tokens ids sizes places", full.astype(np.int32), *(pa.array(cut(x), pa.binary()) for x in (token, doc, size, place)))

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, tokens binary, ids binary, sizes binary, places binary")


PAIRS = "kind int, a bigint, b bigint, list bigint, size int, place int"


def _unpacked(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def lists_of(packed: DataFrame, numer: int, denom: int) -> DataFrame:
    """From each bucket: pairs of short lists (kind 0: a, b), and the entries of long lists (kind 1: leader a, member b, list, size, place)."""

    def run(table: pa.Table) -> pa.Table:
        token, doc = _unpacked(table, "tokens", np.uint64), _unpacked(table, "ids", np.int64)
        size, place = _unpacked(table, "sizes", np.int32), _unpacked(table, "places", np.int32)
        by = np.lexsort((doc, size, token))
        token, doc, size, place = token[by], doc[by], size[by].astype(np.int64), place[by].astype(np.int64)
        fresh = np.append(True, token[1:] != token[:-1])
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        token, doc, size, place, group = token[many], doc[many], size[many], place[many], group[many]
        length = np.bincount(group)[group] if len(group) else group
        first, second, leaders = [], [], []
        # Short lists: all pairs, by distance in the list.
        for step in range(1, SHORT):
            i = np.flatnonzero((group[step:] == group[:-step]) & (length[step:] <= SHORT)) if len(group) > step else np.zeros(0, np.int64)
            first.append(i)
            second.append(i + step)
        # Long lists: a leader takes all members that its size admits; the first one beyond leads next.
        rest = np.flatnonzero(length > SHORT)
        leader = np.full(len(group), -1)
        while len(rest):
            head = np.append(True, group[rest][1:] != group[rest][:-1])
            lead = rest[np.flatnonzero(head)[np.cumsum(head) - 1]]
            near = denom * size[lead] >= numer * size[rest]
            leader[rest[near]] = lead[near]
            rest = rest[~near]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
        good = allowed(size[a], place[a], size[b], place[b], numer, denom) & (doc[a] != doc[b])
        pairs = np.unique(np.stack([np.minimum(doc[a], doc[b])[good], np.maximum(doc[a], doc[b])[good]]), axis=1) if good.any() else np.zeros((2, 0), np.int64)
        at = np.flatnonzero(leader >= 0)
        n, m = pairs.shape[1], len(at)
        zero = np.zeros(n, np.int64)
        return pa.table({
            "kind": pa.array(np.append(np.zeros(n), np.ones(m)).astype(np.int32)),
            "a": np.append(pairs[0], doc[leader[at]]), "b": np.append(pairs[1], doc[at]), "list": np.append(zero, token[at].view(np.int64)),
            "size": np.append(zero, size[at]).astype(np.int32), "place": np.append(zero, place[at]).astype(np.int32),
        })

    return packed.groupBy("bucket").applyInArrow(run, PAIRS)


def allowed(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, numer: int, denom: int) -> np.ndarray:
    """Whether a first shared shingle at these positions leaves enough of both sets for a link."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    left = np.minimum(size_a - place_a, size_b - place_b)
    return (denom * small >= numer * large) & (left >= least_overlap(size_a, size_b, numer, denom))


def size_bands(numer: int, denom: int, top: int) -> np.ndarray:
    """First sizes of the bands: sets that link lie in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(edges[-1] * denom // numer + 1)
    return np.array(edges, np.int64)


def banded(entries: DataFrame, numer: int, denom: int, top: int) -> DataFrame:
    """Entries with the band in which they are the smaller set of a pair (own) and the one below, where they are only the larger."""
    edges = F.array(*(F.lit(int(x)) for x in size_bands(numer, denom, top)))  # some tens
    own = F.size(F.filter(edges, lambda x: x <= F.col("size")))
    both = F.explode(F.array(F.struct(own.alias("band"), F.lit(True).alias("own")), F.struct((own - 1).alias("band"), F.lit(False).alias("own"))))
    return entries.withColumn("x", both).select(*entries.columns, "x.band", "x.own")


def candidates(group: np.ndarray, size: np.ndarray, place: np.ndarray, own: np.ndarray, numer: int, denom: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs of one list, in chunks, from entries in order of list and size; i is the smaller set and its own.

    A block of entries is skipped if even its least position leaves too little of both sets.
    """
    n = len(group)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:n])
    number = np.cumsum(np.append(True, group[1:] != group[:-1])[:n]) - 1
    end = np.append(first[1:], n)[number]
    starts = np.flatnonzero((np.arange(n) - first[number]) % SKIP_BLOCK == 0)
    block = np.searchsorted(starts, np.arange(n), "right") - 1
    ends, least = np.append(starts[1:], n), np.minimum.reduceat(place, starts)
    # The entries that a size admits end where the next list or a larger set begins.
    wide = int(size.max()) * denom // numer + 2
    stop = np.minimum(end, np.searchsorted(number * wide + size, number * wide + denom * size // numer, "right"))
    every = np.flatnonzero(own & (stop > np.arange(n) + 1))
    blocks = block[stop[every] - 1] - block[every] + 1
    for part in np.split(every, np.searchsorted(np.cumsum(blocks), np.arange(CHUNK, blocks.sum(), CHUNK), "right")):
        many = block[stop[part] - 1] - block[part] + 1
        i = np.repeat(part, many)
        b = block[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        lo, hi = np.maximum(starts[b], i + 1), np.minimum(ends[b], stop[i])
        good = hi > lo
        i, b, lo, hi = i[good], b[good], lo[good], hi[good]
        good = size[hi - 1] - least[b] >= least_overlap(size[i], size[lo], numer, denom)
        i, lo, many = i[good], lo[good], (hi - lo)[good]
        for at in range(0, len(i), CHUNK // SKIP_BLOCK):
            x = slice(at, at + CHUNK // SKIP_BLOCK)
            j = np.repeat(lo[x] - (np.cumsum(many[x]) - many[x]), many[x]) + np.arange(int(many[x].sum()))
            yield np.repeat(i[x], many[x]), j


def differences(raw: list[bytes | None], i: np.ndarray, raw_j: list[bytes | None], j: np.ndarray) -> np.ndarray:
    """In how many places the sketches raw[i] and raw_j[j] differ at the width of the narrower one; 0 where one is missing."""
    out = np.zeros(len(i), np.int64)
    sides = []
    for rows, at in ((raw, i), (raw_j, j)):
        width = np.array([len(x or b"") // 8 for x in rows], np.int64)
        sides.append((rows, width, at))
    width = np.minimum(sides[0][1][i], sides[1][1][j]) if len(i) else out
    for w in np.unique(width[width > 0]):
        chosen = np.flatnonzero(width == w)
        tables = []
        for rows, widths, at in sides:
            used, place = np.unique(at[chosen], return_inverse=True)
            folded = np.zeros((len(used), w), np.uint64)
            for v in np.unique(widths[used]):
                these = np.flatnonzero(widths[used] == v)
                whole = np.frombuffer(b"".join(rows[k] for k in used[these]), np.uint64).reshape(len(these), v // w, w)
                folded[these] = np.bitwise_xor.reduce(whole, axis=1)
            tables.append((folded, place))
        (left, x), (right, y) = tables
        step = max(1, CHUNK // int(w))
        for k in range(0, len(chosen), step):
            t = slice(k, k + step)
            out[chosen[t]] = np.bitwise_count(left[x[t]] ^ right[y[t]]).sum(axis=1, dtype=np.int64)
    return out


#: Which pairs a list hands on: of each entry the one with the sketches most alike, of each two components one, or all.
ENTRY, LABELS, ALL = "entry", "labels", "all"


def first_of_each(key: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Places of the rows that are first by the given columns among those of their key."""
    order = np.lexsort((*by[::-1], key))
    return order[np.append(True, key[order][1:] != key[order][:-1])[: len(key)]]


def remaining(entries: DataFrame, verified: DataFrame, labels: DataFrame, sketches: DataFrame, numer: int, denom: int, *, give: str) -> DataFrame:
    """Pairs (a, b) of long lists that neither the leaders' answers nor the sketches connect or exclude, all or as give says."""
    overlap = verified.select("a", "b", "overlap")
    both = overlap.unionAll(overlap.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    rows = entries.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = rows.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("length")).where("lo <> hi").select("list", "length")
    rows = staged(rows.join(mixed, "list"), "mixed-lists")
    total, top = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    rows = rows.join(both, ["a", "b"], "left").join(sketches.select("b", "small"), "b", "left")
    # A leader's own overlap is its size; a member whose pair was not worth verifying has no known overlap.
    rows = rows.withColumn("overlap", F.when(F.col("a") == F.col("b"), F.col("size").cast("bigint")).otherwise(F.coalesce("overlap", F.lit(-1))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("size", "ascending"), ("place", "ascending"), ("b", "ascending")])
        group, lead, doc, size, place, label, overlap = (table.column(c).to_numpy().astype(np.int64) for c in ("list", "a", "b", "size", "place", "label", "overlap"))
        own = table.column("own").to_numpy(zero_copy_only=False)
        raw = table.column("small").to_pylist()
        first, second, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def chosen(i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if give == ENTRY:
                at = np.union1d(first_of_each(i, differ, j), first_of_each(j, differ, i))
            elif give == LABELS:
                lo, hi = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                _, key = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
                at = first_of_each(key.ravel(), differ, i, j)
            else:
                return i, j, differ
            return i[at], j[at], differ[at]

        for i, j in candidates(group, size, place, own, numer, denom):
            good = (label[i] != label[j]) & allowed(size[i], place[i], size[j], place[j], numer, denom)
            i, j = i[good], j[good]
            known = (lead[j] == lead[i]) & (overlap[j] >= 0) & (overlap[i] >= 0)
            most = np.minimum(overlap[i], overlap[j]) + np.minimum(size[i] - overlap[i], size[j] - overlap[j])
            ok = ~known | ((most >= least_overlap(size[i], size[j], numer, denom)) & (lead[i] != doc[j]) & (lead[j] != doc[i]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            differ = differences(raw, i, raw, j)
            near = (size[i] + size[j] - differ) // 2 >= least_overlap(size[i], size[j], numer, denom)
            if near.any():
                for out, value in zip((first, second, apart), chosen(i[near], j[near], differ[near])):
                    out.append(value)
        i, j, _ = chosen(np.concatenate(first), np.concatenate(second), np.concatenate(apart))
        found = np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]), axis=1)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    names = ["list", "a", "b", "size", "place", "label", "overlap", "small"]
    parts = max(1, -(-(total or 0) // DEAL_ENTRIES))
    whole = rows.where(F.col("length") <= WHOLE).select(*names, F.lit(0).alias("band"), F.lit(True).alias("own"), F.pmod(F.xxhash64("list"), F.lit(parts)).alias("part"))
    long = banded(rows.where(F.col("length") > WHOLE).select(*names), numer, denom, top or 1).withColumn("part", F.col("list"))
    pairs = whole.unionAll(long.select(*whole.columns)).groupBy("part", "band").applyInArrow(run, "a bigint, b bigint")
    return pairs.distinct().join(verified, ["a", "b"], "left_anti")


def worthwhile(pairs: DataFrame, sketches: DataFrame, numer: int, denom: int) -> DataFrame:
    """The pairs (a, b) that their whole sketches do not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            differ = differences(batch.column("x").to_pylist(), at, batch.column("y").to_pylist(), at)
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            near = (m + n - differ) // 2 >= least_overlap(m, n, numer, denom)
            yield batch.select(["a", "b"]).filter(pa.array(near | (m < 0) | (n < 0)))

    none = F.lit(-1).cast("bigint")
    x = sketches.select(F.col("b").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("m"))
    y = sketches.select("b", F.col("sketch").alias("y"), "n")
    both = pairs.select("a", "b").join(x, "a", "left").join(y, "b", "left").select("a", "b", "x", "y", F.coalesce("m", none).alias("m"), F.coalesce("n", none).alias("n"))
    return both.mapInArrow(run, "a bigint, b bigint")


def verify(docs: DataFrame, pairs: DataFrame, words: int, numer: int, denom: int) -> DataFrame:
    """The pairs (a, b and their labels la, lb) with overlap and linked, from the whole sets of both; written once, the sets are removed."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    few = 2 * pairs.count() <= BROADCAST_IDS
    needed = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in shingle_sets(batches, words):
            yield _batch("doc_id shingles", part.column("doc_id"), pa.array([s.tobytes() for s in found], pa.binary()))

    every = staged(needed.mapInArrow(sets, "doc_id bigint, shingles binary"), "pair-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                n = int((t[at] == s).sum()) if len(t) else 0
                both.append(n)
                linked.append(n > 0 and denom * n >= numer * (len(s) + len(t) - n))
            yield _batch("a b la lb overlap linked", *(batch.column(c) for c in ("a", "b", "la", "lb")), pa.array(both, pa.int64()), pa.array(linked, pa.bool_()))

    x = every.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = every.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b", "la", "lb").join(y, "b").join(x, "a")
    out = staged(both.mapInArrow(compare, "a bigint, b bigint, la bigint, lb bigint, overlap bigint, linked boolean"), "verified")
    discard(every)
    return out


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose documents no chain of links connects yet, with both labels."""
    x = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    y = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rows = pairs.select("a", "b").join(x, "a", "left").join(y, "b", "left")
    return rows.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")


def jumped(parents: DataFrame) -> DataFrame:
    """(node, label): the end of each chain of parents (node, label), where labels are smaller than nodes."""
    while True:
        further = parents.select(F.col("node").alias("via"), F.col("label").alias("further"))
        rows = staged(parents.join(further, parents.label == further.via, "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "parents")
        parents = rows.select("node", "label")
        if rows.where("moved").limit(1).count() == 0:
            return parents


def connect(docs: DataFrame, pairs: DataFrame, labels: DataFrame, bound: tuple[int, int, int], rounds: int) -> tuple[DataFrame, DataFrame]:
    """The answers of the verified pairs, and the label of every document that is not the smallest of its component.

    In each of the first rounds every component verifies one pair only, with the smallest component it may link to, so a
    group of near copies becomes one component by about as many comparisons as it has members; then what still lies
    across components is verified.
    """
    pending, answers = staged(pairs, "pending"), docs.sparkSession.createDataFrame([], "a bigint, b bigint, overlap bigint, linked boolean")
    for number in range(rounds + 1):
        give_back(docs.sparkSession)  # each round broadcasts small tables
        pending = staged(across(pending, labels), "pending")
        chosen = pending
        if number < rounds:
            one = F.min_by(F.struct("a", "b", "la", "lb"), F.struct(F.least("la", "lb"), "a", "b")).alias("x")
            chosen = staged(pending.groupBy(F.greatest("la", "lb").alias("g")).agg(one).select("x.*"), "chosen")
        if chosen.count() == 0:
            break
        got = verify(docs, chosen, *bound)
        answers = answers.unionAll(got.select(*answers.columns))
        steps = got.where("linked").select(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("label"))
        if steps.limit(1).count():
            if number < rounds:
                roots = jumped(steps)  # one smaller parent each
            else:
                roots = components(steps.select(F.col("node").alias("a"), F.col("label").alias("b"))).where("node <> label")
            up = roots.select(F.col("node").alias("via"), F.col("label").alias("root"))
            moved = labels.join(up, labels.label == up.via, "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = staged(moved.unionAll(roots), "labels")
        pending = across(pending, labels).select("a", "b").join(chosen.select("a", "b"), ["a", "b"], "left_anti")
    return answers, labels


def jaccard_components(docs: DataFrame, *, words: int = WORDS, numer: int = NUMER, denom: int = DENOM) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is named by its smallest doc_id."""
    docs = docs.select("doc_id", "text")
    described = staged(describe(docs, words), "sets")
    sizes = described.where("kind = 0").select("doc_id", "n", "a", "b")
    levels = global_order(described.where("kind = 1").select("a", "sketch"))
    # Equal sets are links that need no list.
    same = sizes.where("n > 0 and doc_id is not null")
    least = same.groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumnsRenamed({"n": "_n", "a": "_a", "b": "_b"})
    least = staged(least, "classes")
    heavy: dict[int, dict] = {}
    for r in most_frequent(least, "rows", HEAVY).collect():
        heavy.setdefault(r["_a"] % (1 << 64), {})[r["_n"], r["_b"] % (1 << 64)] = r["first"]
    copies = same.join(least, (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).where("doc_id <> first")
    labels = staged(copies.select(F.col("doc_id").alias("node"), F.col("first").alias("label")).groupBy("node").agg(F.min("label").alias("label")), "labels")
    per_doc = F.expr(f"n - (({numer} * n + {denom - 1}) div {denom}) + 1")
    entries = sizes.where("n > 0").agg(F.sum(per_doc)).first()[0] or 0
    buckets = max(8, -(-entries // BUCKET_ENTRIES))
    packed = index_entries(docs, levels, heavy, buckets, words, numer, denom)
    del levels
    give_back(docs.sparkSession)
    found = staged(lists_of(packed, numer, denom), "lists")
    bound = (words, numer, denom)
    entries = found.where("kind = 1")
    led = entries.where("a <> b").groupBy("b").agg(F.min("a").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # A doc_id with several sets has no sketch, so nothing is excluded by it.
    needed = found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    one = (F.min("n") == F.max("n")) & (F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))
    each = described.where("kind = 0").join(needed, "doc_id", "left_semi").groupBy("doc_id")
    each = each.agg(F.when(one, F.max("n")).alias("n"), F.when(one, F.max("sketch")).alias("sketch"), F.when(one, F.max("small")).alias("small"))
    sketches = staged(each.withColumnRenamed("doc_id", "b"), "sketches")
    near = across(found.where("kind = 0").select("a", "b").unionAll(led).distinct(), labels)
    answers, labels = connect(docs, worthwhile(near, sketches, numer, denom), labels, bound, ROUNDS)
    for give in (ENTRY, LABELS, ALL):
        give_back(docs.sparkSession)
        more = remaining(entries, answers, labels, sketches, numer, denom, give=give)
        got, labels = connect(docs, worthwhile(more, sketches, numer, denom), labels, bound, 1)
        answers = answers.unionAll(got)
    discard(sketches)
    discard(found)
    out = sizes.join(labels, sizes["doc_id"] == labels["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, words: int = 5, numer: int = 80, denom: int = 100) -> DataFrame:
    """The documents with the smallest doc_id of each component, and those of null doc_id, with all columns."""
    found = jaccard_components(docs, words=words, numer=numer, denom=denom)
    lost = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    few = lost.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(lost) if few else lost, "doc_id", "left_anti").select(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
