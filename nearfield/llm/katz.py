"""Katz backoff bigram model over words.

Tokens are words, A-Z as a-z, then one end; the first token's history is a start symbol. With c the counts of the
training texts and d the Good-Turing discounts of counts 1 to LIMIT,

  P(w | h) = d(c(h, w)) c(h, w) / c(h)          where the pair was seen,
           = alpha(h) P(w)                       where only the history was seen,
           = P(w)                                where the history was not,
  P(w)     = d1(c(w)) c(w) / N, and what the discounts leave goes to one unknown word.

alpha(h) = (1 - mass of the pairs seen) / (1 - P(words seen after h)) for every history, so each distribution sums to
1 exactly. A history whose pairs all have larger counts is left no mass; its pairs are scaled by c(h) / (c(h) + 1).

Counts of words lie in a table; those of pairs are taken bucket by bucket. Words are 64-bit hashes. Only the HEAD most frequent words with their counts
are broadcast; all other words' counts are joined. Events (history, word, text) move once, packed by a hash of the
history; a history with a large share of all tokens is split by word as well. Each bucket counts its pairs, adds up
what it can of each text's score and hands on, for the unseen rest, what alpha and P(w) of rare words need.

A null or empty text is the end alone. Every row is scored by itself, rows of equal doc_id and text too. Without
training texts N is 0 and P(w) is 1 for the unknown word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import PLACE, documents, hash_words, located, mix, most_frequent, pieces_of, staged, text_bytes

#: Counts above this are not discounted.
LIMIT = 5
HEAD = 1 << 18
#: Events of a bucket.
BUCKET_EVENTS = 1_000_000
#: A history with more than this share of a bucket is split by word.
HOT = 0.25
#: Tokens counted together in a task.
COUNT_BLOCK = 1 << 22
#: Bytes of text whose events are packed together.
PIECE_BYTES = 4 << 20
#: A bucket's sums of logarithms, none above 0, are handed on in these parts of one (an error below 1e-11 each).
FIXED = float(1 << 36)
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def discounts(n: list[float]) -> list[float]:
    """d(1) .. d(LIMIT) by Good-Turing from n[0] .. n[LIMIT], the numbers of items seen once, twice, ..; half a count off where they can't be had."""
    out = [1 - 0.5 / r for r in range(1, LIMIT + 1)]
    if n[0] <= 0:
        return out
    tail = (LIMIT + 1) * n[LIMIT] / n[0]
    for r in range(1, LIMIT + 1):
        if n[r - 1] > 0 and tail < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
            out[r - 1] = d if 0 < d < 1 else out[r - 1]
    return out


class Unigrams:
    """P(w) by count; what is left is the unknown word's."""

    def __init__(self, total: int, count_of_counts: dict[int, int], rest: int):
        self.total, self.d = total, discounts([count_of_counts.get(r, 0) for r in range(1, LIMIT + 2)])
        kept = sum(self.d[r - 1] * r * count_of_counts.get(r, 0) for r in range(1, LIMIT + 1)) + rest
        self.scale = 1.0
        if total and kept >= total:  # nothing is left: make room for one more token
            self.scale = total / (total + 1)
        self.unknown = 1.0 - self.scale * kept / total if total else 1.0

    def table(self) -> np.ndarray:
        """P(w) for counts 0 .. LIMIT."""
        return np.array([self.unknown, *(self.scale * d * r / max(1, self.total) for r, d in enumerate(self.d, 1))])

    def of(self, count: np.ndarray) -> np.ndarray:
        small = self.table()
        return np.where(count <= LIMIT, small[np.minimum(count, LIMIT)], self.scale * count / max(1, self.total))

    def column(self, count: Column) -> Column:
        small = F.array(*map(F.lit, self.table().tolist()))
        return F.when(count <= LIMIT, F.get(small, count.cast("int"))).otherwise(count * (self.scale / max(1, self.total)))


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) and how often each occurs."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.flatnonzero(np.append(len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return a[new], b[new], np.diff(np.append(new, len(a)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, train, text); the key is the number of the row's file and its place in it, so no two rows share one."""
    rows = located(docs.select("doc_id", "text"))
    files = sorted(r[0] for r in rows.select(PLACE[0]).distinct().collect())  # the driver has listed them to read them
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"_nf_number bigint, {PLACE[0]} string")
    key = F.shiftleft(F.col("_nf_number"), 40) + F.col(PLACE[1])
    return rows.join(F.broadcast(numbers), PLACE[0]).select("doc_id", key.alias("key"), (~held_out(F.col("doc_id"))).alias("train"), "text")


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, their histories and the text each belongs to."""
    data, offsets = text_bytes(part.column("text"))
    words, first = hash_words(data, offsets)
    n = len(first) - 1
    token = np.full(len(words) + n, END)
    token[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[first[:-1] + np.arange(n)] = START
    return token, history, np.repeat(np.arange(n), np.diff(first) + 1)


def unigram_counts(rows: DataFrame) -> DataFrame:
    """(w, c) of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])

        for batch in batches:
            for part in pieces_of(batch):
                token = tokens_of(part)[0]
                held.append(token)
                n += len(token)
                if n >= COUNT_BLOCK:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    return rows.where("train").select("text").mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def base_parts(rows: DataFrame, head, total: int, types: int) -> DataFrame:
    """Of each text (whole) its tokens n and what frequent words add to the base score, and (not whole) each other word w with how often it occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shared.value
        logs = np.log10(np.append(counts + 1.0, 1.0) / (total + types + 1))
        for batch in batches:
            for part in pieces_of(batch):
                token, _, doc = tokens_of(part)
                key, n = part.column("key").to_numpy(), part.num_rows
                at = np.minimum(np.searchsorted(words, token), max(0, len(words) - 1))
                hit = words[at] == token if len(words) else np.zeros(len(token), bool)
                base = np.bincount(doc[hit], logs[at[hit]], n)
                rare_doc, rare, times = unique_pairs(doc[~hit], token[~hit])
                none = np.zeros(len(rare))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(key, key[rare_doc])),
                        pa.array(np.append(np.ones(n, bool), none.astype(bool))),
                        pa.array(np.append(key, rare.view(np.int64))),
                        pa.array(np.append(np.bincount(doc, minlength=n), times).astype(np.int64)),
                        pa.array(np.append(base, none)),
                        pa.array(np.append(np.bincount(doc[hit], minlength=n), none).astype(np.int64)),
                    ],
                    names=["key", "whole", "w", "n", "base", "known"],
                )

    return rows.select("key", "text").mapInArrow(run, "key bigint, whole boolean, w bigint, n bigint, base double, known bigint")


def narrowed(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the fewest bytes that hold them all."""
    most = int(x.max(initial=0))
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def packed_arrays(arrays: list[np.ndarray], packer: zstandard.ZstdCompressor) -> bytes:
    """Arrays of unsigned numbers as compressed bytes, first bytes before second ones: the upper ones are mostly zero."""
    head = np.array([[x.itemsize, len(x)] for x in arrays], np.int64).tobytes()
    return packer.compress(head + b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays))


def unpacked_arrays(raw: bytes, n: int, unpacker: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    """Those n arrays."""
    raw, at, out = unpacker.decompress(raw), 16 * n, []
    for size, length in np.frombuffer(raw, np.int64, 2 * n).reshape(n, 2).tolist():
        cells = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(cells.T).view(f"u{size}").ravel())
        at += size * length
    return out


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about that many bytes of text, also over several batches; keys of a piece are less than 2^31 apart."""

    def whole() -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None):
            key = batch.column("key").to_numpy()
            ends = [0, *(np.flatnonzero(key[1:] >> 31 != key[:-1] >> 31) + 1).tolist(), len(key)]
            yield from (batch.slice(i, j - i) for i, j in zip(ends, ends[1:]) if j > i)

    held, size = [], 0
    for batch in batches:
        for part in pieces_of(batch, most):
            n = int(text_bytes(part.column("text"))[1][-1])
            if held and size + n > most:
                yield from whole()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from whole()


def as_places(words: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' places among the sorted words, len(words) for all others, and which these are."""
    at = np.minimum(np.searchsorted(words, token), max(0, len(words) - 1))
    hit = words[at] == token if len(words) else np.zeros(len(token), bool)
    return np.where(hit, at, len(words)).astype(np.uint32), ~hit


def from_places(words: np.ndarray, place: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens again, and which are not among the words."""
    is_rare = place == len(words)
    token = words[np.minimum(place, max(0, len(words) - 1))] if len(words) else np.zeros(len(place), np.uint64)
    token[is_rare] = rare
    return token, is_rare


def events(rows: DataFrame, head, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed events by bucket and piece of text: runs of histories, words, both as places among the frequent ones or hashes, and texts.

    A text is its key less the piece's least one, twice, and whether it trains; so an event costs the same in any number of buckets.
    """
    shared = rows.sparkSession.sparkContext.broadcast((head[0], hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot_words = shared.value
        packer = zstandard.ZstdCompressor(level=1)
        for part in gathered(batches, PIECE_BYTES):
            token, history, doc = tokens_of(part)
            bucket = mix(history) % np.uint64(buckets)
            if len(hot_words):
                is_hot = hot_words[np.minimum(np.searchsorted(hot_words, history), len(hot_words) - 1)] == history
                bucket[is_hot] = mix(history[is_hot] ^ mix(token[is_hot])) % np.uint64(buckets)
            by = np.lexsort((history, bucket))
            keys = part.column("key").to_numpy()
            base = int(keys.min())
            text = ((keys - base) * 2 + part.column("train").to_numpy(zero_copy_only=False)).astype(np.uint64)
            token, history, text, bucket = token[by], history[by], narrowed(text)[doc[by]], bucket[by]
            place, rare = as_places(words, token)
            # A run is of one history in one bucket.
            new = np.flatnonzero(np.append(True, (history[1:] != history[:-1]) | (bucket[1:] != bucket[:-1])))
            runs, (before, unknown) = np.diff(np.append(new, len(history))), as_places(words, history[new])
            numbers = np.arange(buckets + 1).astype(np.uint64)
            edge, edge_run = np.searchsorted(bucket, numbers), np.searchsorted(bucket[new], numbers)
            full, out = np.flatnonzero(np.diff(edge)), []
            for b in full:
                s, r = slice(edge[b], edge[b + 1]), slice(edge_run[b], edge_run[b + 1])
                out.append(packed_arrays([before[r], history[new[r]][unknown[r]], narrowed(runs[r]), place[s], token[s][rare[s]], text[s]], packer))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), base)), pa.array(out, pa.binary())], names=["bucket", "base", "events"])

    return rows.select("key", "train", "text").mapInArrow(run, "bucket int, base bigint, events binary")


#: kinds: 0 packed sums of texts (a: least key of their piece); 1 history (a) with its seen mass by class and P of frequent words seen; 2 text (b) with n unseen
#: words after history (a); 3 text (b) with n unseen rare words (a); 4 rare word (b) seen after history (a); 5 pairs (n) seen a times.
RESULT = "kind int, a bigint, b bigint, n bigint, mass array<bigint>, p double, sums binary"


def counted(packed: DataFrame, head, hot: np.ndarray, hot_counts: np.ndarray, unigrams: Unigrams) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast((head, hot, hot_counts, unigrams))

    def run(table: pa.Table) -> pa.Table:
        (words, word_counts), hot_words, hot_n, model = shared.value
        packer, unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        bases = table.column("base").to_numpy()
        hs, ws, keys, trained, is_rare = [], [], [], [], []
        for i, raw in enumerate(table.column("events")):
            before, unknown, runs, place, rare_words, text = unpacked_arrays(raw.as_py(), 6, unpacker)
            w, rare = from_places(words, place, rare_words)
            hs.append(np.repeat(from_places(words, before, unknown)[0], runs))
            ws.append(w)
            keys.append((text >> 1).astype(np.int64) + (i << 32))  # the number of the piece and the place in it
            trained.append((text & 1).astype(bool))
            is_rare.append(rare)
        h, w, key, train, rare = map(np.concatenate, (hs, ws, keys, trained, is_rare))
        del hs, ws, keys, trained, is_rare
        by = np.lexsort((w, h))
        h, w, key, train, rare = h[by], w[by], key[by], train[by], rare[by]
        new_h = np.append(True, h[1:] != h[:-1])
        new_pair = new_h | np.append(True, w[1:] != w[:-1])
        pair = (np.cumsum(new_pair) - 1).astype(np.int32)
        at = np.flatnonzero(new_pair)
        c = np.add.reduceat(train.astype(np.int64), at)  # of each pair
        group = np.cumsum(new_h[at]) - 1  # history of each pair
        g_at = np.flatnonzero(new_h[at])
        g_h = h[at][g_at]
        c_h = np.add.reduceat(c, g_at)
        split = np.zeros(len(g_h), bool)
        if len(hot_words):
            i = np.minimum(np.searchsorted(hot_words, g_h), len(hot_words) - 1)
            split = hot_words[i] == g_h
            c_h = np.where(split, hot_n[i], c_h)
        p_rare = rare[at]
        j = np.minimum(np.searchsorted(words, w[at]), max(0, len(words) - 1))
        p1 = np.where(p_rare, 0.0, model.of(np.where(p_rare, 0, word_counts[j] if len(words) else 0)))
        seen = c > 0
        # Classes of each history's seen pairs: how many have count 1 .. LIMIT, and the sum of larger counts.
        mass = np.stack([np.add.reduceat((c == r).astype(np.int64), g_at) for r in range(1, LIMIT + 1)] + [np.add.reduceat(np.where(c > LIMIT, c, 0), g_at)], axis=1)
        p_seen = np.add.reduceat(np.where(seen, p1, 0.0), g_at)
        # Events of texts.
        e_c, e_ch = c.astype(np.int32)[pair], c_h[group][pair]
        e_seen = e_c > 0
        logs = np.where(e_seen, np.log10(np.maximum(e_c, 1)) - np.log10(np.maximum(e_ch, 1)), 0.0)
        logs += np.where(~e_seen & ~rare, np.log10(np.where(p1 > 0, p1, 1.0))[pair], 0.0)
        texts, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, logs)
        small = np.stack([np.bincount(inverse[e_c == r], minlength=len(texts)) for r in range(1, LIMIT + 1)], axis=1).astype(np.int32)
        key_of = lambda k: bases[k >> 32] + (k & 0xFFFFFFFF)
        rows: dict[str, list] = {x: [] for x in ("kind", "a", "b", "n", "mass", "p", "sums")}

        def add(kind: int, n: int, a=None, b=None, count=None, mass_=None, p=None, sums=None) -> None:
            kinds = {"a": (a, pa.int64()), "b": (b, pa.int64()), "n": (count, pa.int64()), "mass": (mass_, pa.list_(pa.int64())), "p": (p, pa.float64()), "sums": (sums, pa.binary())}
            rows["kind"].append(pa.array(np.full(n, kind, np.int32)))
            for name, (value, kind_) in kinds.items():
                rows[name].append(pa.nulls(n, kind_) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind_))

        cut = np.searchsorted(texts, np.arange(len(bases) + 1) << 32)
        spans = [slice(i, j) for i, j in zip(cut, cut[1:])]
        fixed = np.rint(-total * FIXED).astype(np.uint64)
        packed_sums = [packed_arrays([narrowed(np.diff(texts[o], prepend=(i << 32))), narrowed(fixed[o]), narrowed(small[o].T.ravel())], packer) for i, o in enumerate(spans)]
        add(0, len(bases), a=bases, sums=pa.array(packed_sums, pa.binary()))
        need = ~e_seen & (e_ch > 0)
        g_need = np.zeros(len(g_h), bool)
        g_need[group[pair[need]]] = True
        g_need |= split | (mass[:, :LIMIT].sum(axis=1) == 0)
        k = np.flatnonzero(g_need & (c_h > 0))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * (LIMIT + 1)), pa.array(mass[k].ravel()))
        add(1, len(k), a=g_h[k].view(np.int64), count=c_h[k], mass_=flat, p=p_seen[k])
        a, b, n = unique_pairs(h[need].view(np.int64), key[need])
        add(2, len(n), a=a, b=key_of(b), count=n)
        lost = ~e_seen & rare
        a, b, n = unique_pairs(w[lost].view(np.int64), key[lost])
        add(3, len(n), a=a, b=key_of(b), count=n)
        tail = seen & p_rare & g_need[group]
        add(4, int(tail.sum()), a=g_h[group[tail]].view(np.int64), b=w[at][tail].view(np.int64))
        # Histories without small counts in this bucket: where that holds in all buckets, their pairs are scaled.
        large = e_seen & (mass[:, :LIMIT].sum(axis=1) == 0)[group][pair]
        a, b, n = unique_pairs(h[large].view(np.int64), key[large])
        add(6, len(n), a=a, b=key_of(b), count=n)
        add(5, LIMIT + 1, a=np.arange(1, LIMIT + 2), count=np.array([(c == r).sum() for r in range(1, LIMIT + 2)]))
        return pa.table({name: pa.chunked_array(value) for name, value in rows.items()})

    return packed.groupBy("bucket").applyInArrow(run, RESULT)


def text_sums(found: DataFrame, log_d: list[float]) -> DataFrame:
    """(key, sum) of the packed sums, with the discounts of small counts."""

    def run(table: pa.Table) -> pa.Table:
        unpacker, keys, sums = zstandard.ZstdDecompressor(), [], []
        for raw in table.column("sums"):
            text, total, small = unpacked_arrays(raw.as_py(), 3, unpacker)
            keys.append(text.cumsum(dtype=np.int64))
            sums.append(np.array(log_d) @ small.reshape(LIMIT, len(text)) - total / FIXED)
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.table({"key": table.column("a")[0].as_py() + key, "sum": np.bincount(inverse, np.concatenate(sums))})

    return found.where("kind = 0").select("a", "sums").groupBy("a").applyInArrow(run, "key bigint, sum double")


def alphas(found: DataFrame, d: list[float], unigrams: Unigrams, counts: DataFrame) -> DataFrame:
    """(a, alpha, fix) of the histories that unseen words follow; fix is the scale of a history that discounts leave no mass."""
    seen = F.col("m")[LIMIT] + sum(F.col("m")[r - 1] * (d[r - 1] * r) for r in range(1, LIMIT + 1))
    each = found.where("kind = 1").groupBy("a").agg(F.max("n").alias("c"), F.array(*(F.sum(F.col("mass")[i]) for i in range(LIMIT + 1))).alias("m"), F.sum("p").alias("p"))
    rare = found.where("kind = 4").select("a", F.col("b").alias("w")).join(counts, "w").groupBy("a").agg(F.sum(unigrams.column(F.col("c"))).alias("rare"))
    rows = each.join(rare, "a", "left").withColumn("left", 1 - seen / F.col("c"))
    none = F.col("left") < 1e-12
    mass = F.when(none, 1 / (F.col("c") + 1)).otherwise(F.col("left"))
    beyond = F.greatest(1 - F.col("p") - F.coalesce("rare", F.lit(0.0)), F.lit(unigrams.unknown))
    fix = F.when(none, F.log10(F.col("c") / (F.col("c") + 1))).otherwise(0.0)
    return rows.select("a", (mass / beyond).alias("alpha"), fix.alias("fix"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    rows = keyed(docs)
    counts = staged(unigram_counts(rows), "unigrams", compression="zstd")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    of_counts = {r[0]: r[1] for r in counts.where(F.col("c") <= LIMIT + 1).groupBy("c").count().collect()}
    unigrams = Unigrams(total, of_counts, total - sum(r * n for r, n in of_counts.items() if r <= LIMIT))
    top = most_frequent(counts, "c", HEAD).toPandas().sort_values("w", key=lambda w: w.to_numpy(np.int64).view(np.uint64))
    head = (top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64))
    # Base score: words that are not broadcast get their counts by a join.
    parts = base_parts(rows, head, total, types)
    smoothed = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + types + 1)))
    joined = parts.join(counts, "w", "left")
    is_text = F.col("whole")
    base = joined.groupBy("key").agg(
        F.sum(F.when(is_text, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(is_text, F.col("known")).when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(is_text, F.col("base")).otherwise(smoothed * F.col("n"))).alias("base"),
    )
    base = staged(base, "base-scores", compression="zstd")
    # Pairs.
    n_events = base.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(4, -(-n_events // BUCKET_EVENTS))
    is_hot = head[1] > HOT * max(1, total) / buckets
    trained = rows.where("train").count()
    hot = np.append(head[0][is_hot], START)
    hot_counts = np.append(head[1][is_hot], trained)
    by = np.argsort(hot)
    hot, hot_counts = hot[by], hot_counts[by]
    found = staged(counted(events(rows, head, hot, buckets), head, hot, hot_counts, unigrams), "pairs", compression="zstd")
    pairs_of = {r[0]: r[1] for r in found.where("kind = 5").groupBy("a").agg(F.sum("n")).collect()}
    d = discounts([pairs_of.get(r, 0) for r in range(1, LIMIT + 2)])
    sums = text_sums(found, [math.log10(x) for x in d])
    alpha = alphas(found, d, unigrams, counts)
    after = found.where("kind in (2, 6)").select("kind", "a", F.col("b").alias("key"), "n").join(alpha, "a")
    after = after.groupBy("key").agg(F.sum(F.when(F.col("kind") == 2, F.log10("alpha")).otherwise(F.col("fix")) * F.col("n")).alias("sum"))
    rare = found.where("kind = 3").select(F.col("a").alias("w"), F.col("b").alias("key"), "n").join(counts, "w", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log10(unigrams.column(F.coalesce("c", F.lit(0)))) * F.col("n")).alias("sum"))
    model = sums.unionAll(after).unionAll(rare).groupBy("key").agg(F.sum("sum").alias("score"))
    out = rows.select("doc_id", "key", (~F.col("train")).alias("held_out")).join(base, "key").join(model, "key")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), F.col("score"))


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
