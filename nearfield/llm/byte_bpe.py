"""Byte-level BPE with Spark's higher-order functions.

A text is cut by the tokenizer's pattern. A word is an array of its bytes' ids, each with the rank of its pair with the
next; a fold over its length merges, at each step, the leftmost adjacent pair of the least rank, found in a literal rank
map (a perfect hash over pairs of ids), until no pair has a rank. Decoding concatenates the binary pieces of the ids.

The distinct words of all texts are counted; the most frequent ones (at most HEAD_WORDS, a bound on what goes to every
task) are folded once and their ids put into a second literal map, so most words of a text are one lookup; all others are
folded where they stand. So the documents themselves never move. Both maps are
literals of the plan in Spark's own binary arrays, so a task reads each in one piece. A word of n bytes takes up to n merges of up to n steps:
words of many kilobytes without a space are slow, never wrong.

A null or empty text has no ids.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import documents, give_back, most_frequent, staged, text_of

HEAD_WORDS = 1 << 18
#: Pieces up to which a merge is one pass over the word's array; beyond, whole runs are copied.
SHORT_WORD = 48
#: Cells among which a row's first fit is looked for at once.
TRIED = 1 << 12


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern with Unicode's white space, and with the letters and numbers that are newer than the JVM's tables."""

    def unknown(kind: str) -> str:
        every = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)).startswith(kind))
        left = spark.range(1).select(F.regexp_replace(F.lit(every), rf"\p{{{kind}}}+", "").alias("x")).first()[0]
        points = [ord(c) for c in left]
        ends = [i for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
        ranges = "".join(f"\\x{{{points[a]:X}}}-\\x{{{points[b]:X}}}" for a, b in zip([0, *(e + 1 for e in ends)], ends))
        # One comparison keeps all smaller characters from being tried against every range.
        return f"[[\\x{{{points[0]:X}}}-\\x{{10FFFF}}]&&[{ranges}]]" if points else ""

    new = {kind: unknown(kind) for kind in "LN"}
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\p{{IsWhite_Space}}\p{{L}}\p{{N}}{new['L']}{new['N']}]")
    for kind in "LN":
        pattern = pattern.replace(rf" ?\p{{{kind}}}+", rf" ?[\p{{{kind}}}{new[kind]}]+")
    letters = rf" ?[\p{{L}}{new['L']}]+|"
    before, _, after = pattern.partition(letters)
    if after and re.fullmatch(r"('[a-z]+\|)*", before):  # these begin with an apostrophe, so the order is free: letters first are found faster
        pattern = letters + before + after
    return pattern.replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")


def let(value: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """The body, of that type, with value computed once: expressions inside lambdas are not shared otherwise."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def lets(values: list[Column], body: Callable[..., Column], kind: str) -> Column:
    """The same for several values."""
    if not values:
        return body()
    return let(values[0], lambda x: lets(values[1:], lambda *more: body(x, *more), kind), kind)


def literals(row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row table as literals. The values stay in the JVM and as they are: binary arrays, not lists of objects."""
    jvm = row.sparkSession.sparkContext._jvm
    kinds = row._jdf.schema()
    values = row._jdf.queryExecution().executedPlan().executeCollect()[0].copy()
    made = {}
    for i, name in enumerate(row.columns):
        kind = kinds.apply(i).dataType()
        expression = jvm.org.apache.spark.sql.catalyst.expressions.Literal(values.get(i, kind), kind)
        made[name] = Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))
    return made


def interleaved(rows: dict[int, list[int]]) -> tuple[dict[int, int], int]:
    """A shift for each row of sorted columns, so that no two rows share a cell (column + shift), and the number of cells.

    Longest rows first, each at the first fit behind the last row of its length.
    """
    taken, end, shifts, length, begin = np.zeros(1 << 16, bool), 0, {}, 0, 0
    for row, columns in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        cols = np.array(columns) - columns[0]
        if len(taken) <= end + int(cols[-1]):
            taken = np.concatenate([taken, np.zeros(len(taken) + int(cols[-1]) + 1, bool)])
        first, begin, length = end, begin if len(columns) == length else 0, len(columns)
        for at in range(begin, end, TRIED):
            tried = at + np.flatnonzero(~taken[at : min(end, at + TRIED)])
            for c in cols[1:]:
                tried = tried[~taken[tried + c]]
                if not len(tried):
                    break
            if len(tried):
                first = int(tried[0])
                break
        begin = first
        taken[first + cols] = True
        end = max(end, first + int(cols[-1]) + 1)
        shifts[row] = first - columns[0]
    return shifts, end


@dataclass(frozen=True)
class Maps:
    """The bound arrays of a RankMap."""

    shifts: Column
    firsts: Column
    ranks: Column
    start: Column
    last: Column


class RankMap:
    """The rank of each pair of pieces, as flat arrays, and the folds over them.

    A pair (a, b) of piece ids lies in the cell b + the shift of a. The rows of all a are shifted so that no two pairs share
    a cell (a perfect hash), and the cell holds a and the pair's rank: two reads and a comparison, without a modulo.

    A word in the fold is one array<bigint>: for each piece, from the highest bits down, the rank of its pair with the next
    piece (`none` where there is none), the place of its first byte, and its id. So the least element is the leftmost pair
    of the least rank, and the id of a merged piece is that rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values(), default=-1) + 1
        self.bits = (self.width + 1).bit_length()
        self.none, self.top = (1 << self.bits) - 1, 63 - self.bits
        held: dict[int, dict[int, int]] = {}
        for piece, rank in ranks.items():
            for a, b in cuts(piece, ranks):
                held.setdefault(a, {})[b] = rank
        places, cells = interleaved({a: sorted(row) for a, row in held.items()})
        firsts, found = [-1] * cells, [self.none] * cells
        for a, row in held.items():
            for b, rank in row.items():
                firsts[places[a] + b], found[places[a] + b] = a, rank
        shifts = [places.get(a, 0) for a in range(self.width)]
        single = [ranks.get(bytes([i])) for i in range(256)]
        rank_of = lambda a, b: ranks.get(bytes([a, b]), self.none)
        start = [None if single[a] is None else (rank_of(a, b) << self.top) + single[a] for a in range(256) for b in range(256)]
        last = [None if x is None else (self.none << self.top) + x for x in single]
        self.lists = {"shifts": shifts, "firsts": firsts, "ranks": [r << self.top for r in found], "start": start, "last": last}

    def rank(self, maps: Maps, a: Column, b: Column) -> Column:
        """The rank of a pair in its place in an element; `none` also where b is null."""

        at = F.get(maps.shifts, a) + b
        return F.when(F.get(maps.firsts, at) == a, F.get(maps.ranks, at)).otherwise(big(self.none << self.top))

    def id(self, element: Column) -> Column:
        return element.bitwiseAND(big(self.none)).cast("int")

    def ids(self, maps: Maps, word: Column) -> Column:
        """The ids of one word by the fold of ranked merges."""
        codes = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
        place = lambda i: i.cast("bigint") * big(1 << self.bits)
        first = let(codes, lambda c: F.transform(c, lambda x, i: F.coalesce(F.get(maps.start, x * 256 + F.get(c, i + 1)), F.get(maps.last, x)) + place(i)), "array<bigint>")

        def fold(start: Column) -> Column:
            def step(s: Column) -> Column:
                merge = lambda m: F.when(F.size(s) <= SHORT_WORD, self._in_one_pass(maps, s, m)).otherwise(self._spliced(maps, s, m))
                return let(F.array_min(s), lambda m: F.when(m >= big(self.none << self.top), s).otherwise(merge(m)), "array<bigint>")

            return F.aggregate(F.slice(start, 2, F.size(start)), start, lambda s, _: step(s), lambda s: F.transform(s, lambda x: self.id(x)))

        return let(first, fold, "array<int>")

    def _merged(self, maps: Maps, least: Column, after: Column) -> Column:
        """The element of the merged piece, before the piece after it."""
        new = F.shiftright(least, self.top)
        return self.rank(maps, new.cast("int"), self.id(after)) + least.bitwiseAND(big((1 << self.top) - 1 - self.none)) + new

    def _before(self, maps: Maps, least: Column, element: Column) -> Column:
        """The element of the piece before the merged one."""
        return self.rank(maps, self.id(element), F.shiftright(least, self.top).cast("int")) + element.bitwiseAND(big((1 << self.top) - 1))

    def _in_one_pass(self, maps: Maps, s: Column, least: Column) -> Column:
        """One merge of a short word: its piece, the one before and the one swallowed, found by the least element's place in the array."""
        gone = big(-1)

        def change(after: Column) -> Column:
            new = F.transform(s, lambda x, i: F.when(i > after, x).when(i == after, gone).when(x == least, self._merged(maps, least, F.get(s, after + 1))).when(i == after - 2, self._before(maps, least, x)).otherwise(x))
            return F.array_remove(new, gone)

        return let(F.array_position(s, least).cast("int"), change, "array<bigint>")

    def _spliced(self, maps: Maps, s: Column, least: Column) -> Column:
        """One merge of a long word, by copies of whole runs."""

        def at(i: Column) -> Column:
            merged = F.array(self._merged(maps, least, F.get(s, i + 1)))
            left = F.when(i > 1, F.concat(F.slice(s, F.lit(1), i - 2), F.array(self._before(maps, least, F.get(s, i - 2))), merged)).otherwise(merged)
            return F.concat(left, F.slice(s, i + 2, F.size(s)))

        return let(F.array_position(s, least).cast("int"), at, "array<bigint>")


def big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def cuts(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """The ids of all pairs of pieces that make this one."""
    for i in range(1, len(piece)):
        a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
        if a is not None and b is not None:
            yield a, b


class Codec:
    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark = spark
        self.pattern = java_pattern(spark, pattern)
        self.ranks = RankMap(ranks)
        width = self.ranks.width
        names = [""] * width
        for k, v in ranks.items():
            names[v] = k.decode("latin-1")
        little_endian = [i.to_bytes(4, "little").decode("latin-1") for i in range(width)]
        columns = {name: pa.array([x], pa.list_(pa.int32() if name in ("shifts", "firsts") else pa.int64())) for name, x in self.ranks.lists.items()}
        columns |= {"names": pa.array([names], pa.list_(pa.string())), "little_endian": pa.array([little_endian], pa.list_(pa.string()))}
        self.ranks.lists = {}  # the literals hold them from here on
        table = staged(spark.createDataFrame(pa.table(columns)), "bpe-ranks")
        del columns, names, little_endian
        give_back(spark)
        self.arrays = literals(table)
        self.cells, self.head = 0, None

    def bound(self, body: Callable[[Maps], Column], kind: str) -> Column:
        """The body, given the arrays of the rank map, bound once."""
        return lets([self.arrays[f.name] for f in fields(Maps)], lambda *x: body(Maps(*x)), kind)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def learn_head(self, texts: DataFrame, size: int = HEAD_WORDS) -> None:
        """Counts all words of texts(text) and folds the most frequent of the distinct ones once."""
        each = texts.select(F.explode(self.words(text_of())).alias("word"))
        sums = staged(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "bpe-words")
        top = most_frequent(sums, "n", size).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ids = self.bound(lambda maps: self.ranks.ids(maps, F.col("word")), "array<int>")
        self.cells = 1 << max(1, (4 * size // 3 - 1).bit_length())
        words = staged(top.select("word", "n", ids.alias("ids")), "bpe-head")  # at most size rows
        # A cell goes to the most frequent word that names it first, one left free to the most frequent of the others that
        # name it second; a word without a cell is folded where it stands.
        best = F.max_by(F.struct("word", "ids"), F.struct("n", "word")).alias("x")
        first = words.groupBy(self._cell(F.col("word"), 0).alias("cell")).agg(best)
        left = words.join(first.select("x.word"), "word", "left_anti").groupBy(self._cell(F.col("word"), 1).alias("cell")).agg(best)
        taken = first.unionAll(left.join(first.select("cell"), "cell", "left_anti"))
        every = self.spark.range(self.cells).select(F.col("id").cast("int").alias("cell")).join(taken, "cell", "left")
        listed = every.agg(F.sort_array(F.collect_list(F.struct("cell", "x"))).alias("all"))
        self.head = literals(staged(listed.select(F.col("all.x").alias("cells")), "bpe-cells"))["cells"]

    def _cell(self, word: Column, choice: int) -> Column:
        """The place of a word in the head's arrays, by its first or second choice."""
        return (F.hash(word) if choice == 0 else F.hash(word, F.lit(choice))).bitwiseAND(F.lit(self.cells - 1))

    def encode(self, text: Column) -> Column:
        """array<int> of the ids of a text."""
        words, kind = self.words(text), "array<array<int>>"

        def each(maps: Maps) -> Column:
            if self.head is None:
                return F.transform(words, lambda w: self.ranks.ids(maps, w))

            def known(cells: Column, w: Column) -> Column:
                first, second = F.get(cells, self._cell(w, 0)), F.get(cells, self._cell(w, 1))
                found = F.when(first["word"] == w, first["ids"]).when(second["word"] == w, second["ids"])
                return found.otherwise(self.ranks.ids(maps, w))

            return let(self.head, lambda cells: F.transform(words, lambda w: known(cells, w)), kind)

        return F.flatten(self.bound(each, kind))

    def binary(self, ids: Column) -> Column:
        """The ids as little-endian unsigned 32-bit integers."""
        return self._joined("little_endian", ids)

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids."""
        return self._joined("names", ids)

    def _joined(self, pieces: str, ids: Column) -> Column:
        """The concatenation of the ids' binary pieces, each held as the characters U+0000 to U+00FF."""
        joined = let(self.arrays[pieces], lambda bound: F.array_join(F.transform(ids, lambda i: F.get(bound, i)), ""), "string")
        return F.encode(joined, "ISO-8859-1")


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, head_words: int = HEAD_WORDS) -> tuple[DataFrame, Codec]:
    """The columns of docs and ids (array<int>; a clashing column is overwritten), and the codec for further use."""
    codec = Codec(docs.sparkSession, ranks, pattern)
    if head_words:
        codec.learn_head(docs.select("text"), head_words)
    return docs.withColumn("ids", codec.encode(text_of())), codec


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    rows, codec = encode_documents(docs.select("doc_id", "text"), ranks, pattern)
    ids = F.col("ids")
    return rows.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(codec.binary(ids), 256).alias("ids_sha256"), F.sha2(codec.decode(ids), 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
