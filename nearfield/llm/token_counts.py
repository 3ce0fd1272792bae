"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton enumerates the vocabulary's matches that end at each character; the dynamic programme
keeps only the best score and its number of pieces there. Rules are those of the unigram tokenizer: a character
that is no piece costs the least score less 10 and falls back to its UTF-8 bytes; of equal scores the earlier
start wins. Spaces become U+2581, and one is put in front of a text that does not begin with one, as the tokenizers library
does. Where no piece goes on from another character into a space, and scores are whole numbers (whose sums do not depend
on their order), a text is the sum of its words, each with the spaces before it; a word is searched once for as long as it stays in a
bounded cache. Line feeds that are in no piece stand alone as well. Other vocabularies are searched text by text.

A null or empty text has 0 tokens.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.llm.common import Recent, documents

SPACE = "▁"
#: How much below the least score an unknown character lies (fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Words of one generation of a Python worker's cache.
CACHE_WORDS = 600_000

#: Runs of spaces with the word that follows; and the same where line feeds stand alone.
_UNITS, _UNITS_AND_LINES = re.compile(" *[^ ]+| +"), re.compile(" +[^ \n]*|[^ \n]+|\n")

Vocabulary = list[tuple[str, float]]


def load_vocabulary(path: str) -> tuple[Vocabulary, set[int]]:
    """Pieces with scores of a sentencepiece model, and the bytes that have a fallback piece. Control and unknown pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, fallback = [], set()
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            fallback.add(int(model.id_to_piece(i)[3:5], 16))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), float(model.get_score(i))))
    return pieces, fallback


class Counter:
    """Pieces of words and texts."""

    def __init__(self, pieces: Vocabulary, fallback: set[int], least: float | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = (min((s for _, s in pieces), default=0.0) if least is None else least) - UNKNOWN_PENALTY
        self.fallback = fallback
        # A text can be cut in front of each run of spaces unless a piece goes on there.
        self.separable = all(float(score).is_integer() and not re.search(f"[^{SPACE}]{SPACE}", p) for p, score in pieces)
        self.words = Recent(self.word, CACHE_WORDS)
        self.units = _UNITS if any("\n" in p for p, _ in pieces) else _UNITS_AND_LINES

    def word(self, unit: str) -> int:
        return self.search(unit.replace(" ", SPACE))[1]

    def search(self, text: str) -> tuple[float, int]:
        """Best score of the text as it stands, and the pieces of that best segmentation."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count, start = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        done = 0  # up to here every end is final
        singles = bytearray(n + 1)
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            while done < last:  # ends that no further match reaches
                done += 1
                if not singles[done]:
                    self._unknown(text, done, best, count)
            begin = end - length
            if length == 1:
                singles[end] = 1
            total = best[begin] + score
            old = best[end]
            if old is None or total > old or (total == old and begin < start[end]):
                best[end], count[end], start[end] = total, count[begin] + 1, begin
        while done < n:
            done += 1
            if not singles[done]:
                self._unknown(text, done, best, count)
        return best[n], count[n]

    def _unknown(self, text: str, end: int, best: list, count: list) -> None:
        """Lets the character before end be unknown, if that is better."""
        total = best[end - 1] + self.unknown
        if best[end] is None or total > best[end]:
            raw = text[end - 1].encode("utf-8", "surrogatepass")
            best[end], count[end] = total, count[end - 1] + (len(raw) if self.fallback.issuperset(raw) else 1)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        text = text if text[0] == " " else " " + text
        if not self.separable:
            return self.word(text)
        n = sum(map(self.words.__getitem__, self.units.findall(text)))
        self.words = self.words.turned()
        return n


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: tuple[Vocabulary, set[int]]) -> DataFrame:
    """(doc_id, n_tokens) of every row. No shuffle; memory is bounded by the cache and one batch of texts."""
    pieces, fallback = vocabulary
    shared, key = docs.sparkSession.sparkContext.broadcast((pieces, fallback)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(*shared.value)
        counter = _COUNTERS[key]
        for batch in batches:
            texts = batch.column("text")
            n = np.fromiter((counter.count(t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
