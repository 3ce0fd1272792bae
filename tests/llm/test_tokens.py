"""Token counts, byte-level BPE and the token store against the tokenizers' own libraries."""

import base64
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from nearfield.llm import byte_bpe, token_counts, token_store

from .helpers import ODD, table

ROWS = [r for r in ODD if r[0] != 2]
#: One word, longer than what a merge takes in one pass.
LONG_WORD = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(6000))


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def unigram(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, fallback = vocabulary
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{b:02X}>", 0.0) for b in sorted(fallback))], 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return t


def test_counts_match_the_library(spark, vocabulary, unigram):
    spaced = [" hello", "  hello", " a", "▁hello", "▁▁ a b", "hello ", "a ▁ b", " ", "   ", "\n a", "a\n\nb", " ümlaut ▁", "\t x"]
    rows = [*ROWS, *((100 + i, x) for i, x in enumerate(spaced))]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table(spark, rows), vocabulary).collect()}
    assert got == {r[0]: len(unigram.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert token_counts.token_counts(table(spark, []), vocabulary).count() == 0


def test_viterbi_against_all_segmentations():
    pieces = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -2.5), ("abb", -6.0)]
    counter = token_counts.Counter(pieces, set())
    scores = dict(pieces)

    def every(text):
        if not text:
            return [[]]
        return [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in scores or n == 1 for rest in every(text[n:])]

    for text in ("▁ab", "▁abb", "▁aab", "ba", "▁", "abab", "acb"):
        cost = {tuple(s): sum(scores.get(p, counter.unknown) for p in s) for s in every(text)}
        top = max(cost.values())
        score, n = counter.search(text)
        assert score == top and n in {len(s) for s, c in cost.items() if c == top}
    assert counter.search("ab") == (-4.0, 1)  # of equal scores the earlier start wins


def test_a_piece_with_an_inner_space_is_found():
    counter = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("a▁a", -0.5)], set())
    assert not counter.separable and counter.count("a a") == 2
    assert not token_counts.Counter([("▁", -1.5), ("a", -1.0)], set()).separable


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference_bpe(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("head", [0, 8])
def test_bpe_matches_the_library(spark, ranks, reference_bpe, head):
    rows = [*ROWS, (20, "y" * 150 + "  　z <|endoftext|>"), (21, "ࡰ \U00010570x ˀ"), (22, LONG_WORD), (23, "é" * 47 + " " + "ab" * 24 + " " + "abc" * 17)]
    docs = table(spark, rows).withColumn("ids", F.lit("clash"))
    out, codec = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, head_words=head)
    got = out.select("doc_id", "ids", codec.binary(F.col("ids")).alias("raw"), codec.decode(F.col("ids")).alias("back")).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = reference_bpe.encode_ordinary(texts[r["doc_id"]])
        assert list(r["ids"]) == want and bytes(r["raw"]) == np.array(want, "<u4").tobytes() and bytes(r["back"]).decode() == texts[r["doc_id"]]


def test_bpe_digests_and_empty_table(spark, ranks):
    row = byte_bpe.digests(table(spark, [(1, None)]), ranks, public_tokenizers.PATTERN).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (1, 0, nothing, nothing)
    assert byte_bpe.digests(table(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_merge_order_of_a_small_rank_table(spark):
    small = {bytes([i]): i for i in range(97, 100)} | {b"bc": 200, b"ab": 201, b"abc": 202}
    out, _ = byte_bpe.encode_documents(table(spark, [(1, "abc abcab")]).withColumn("text", F.lit("abcab")), small, r"\S+", head_words=0)
    assert list(out.first()["ids"]) == [97, 200, 201] or list(out.first()["ids"]) == [202, 201]
    assert base64.b64encode(b"ab") == b"YWI="


def test_pairs_lie_in_cells_of_their_own(ranks):
    for table in (ranks, {}, {b"a": 0}, {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"\xff\xff": 258}):
        pairs = {(a, b): rank for piece, rank in table.items() for a, b in byte_bpe.cuts(piece, table)}
        made = byte_bpe.RankMap(table)
        cell = {(a, b): made.lists["shifts"][a] + b for a, b in pairs}
        assert len(set(cell.values())) == len(pairs) and all(x >= 0 for x in cell.values())
        assert all(made.lists["firsts"][at] == a and made.lists["ranks"][at] >> made.top == pairs[a, b] for (a, b), at in cell.items())
        assert sum(x >= 0 for x in made.lists["firsts"]) == len(pairs)
    shifts, cells = byte_bpe.interleaved({5: [0, 3], 6: [2], 7: [0, 1, 3], 8: [40_000]})
    assert shifts == {7: 0, 5: 2, 6: 2, 8: 4 - 40_000 + 2} and cells == 7


def test_a_merge_divides_nothing_and_reads_a_head_word_in_one_place(spark, ranks):
    out, codec = byte_bpe.encode_documents(table(spark, [(1, "one two")]), ranks, public_tokenizers.PATTERN, head_words=8)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and " % " not in plan
    assert codec.head._jc.toString().count("UnsafeArrayData") == 1


@pytest.fixture(scope="module")
def word_bpe():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


def test_store_round_trip(spark, tmp_path, word_bpe):
    from tokenizers import Tokenizer

    rows = [*ROWS, *((100 + i, " ".join(f"shared passage {j} of many words" for j in range(400)) + f" tail {i}") for i in range(6))]
    out = str(tmp_path / "store")
    token_store.write_store(table(spark, rows).repartition(3), out, word_bpe, 2)
    t = Tokenizer.from_str(word_bpe)
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_summaries(spark, out).collect()}
    assert got == want
    back = {r["doc_id"]: (r["start"], list(r["ids"])) for r in token_store.read_ids(spark, out).collect()}
    assert back == {i: (want[i][0], ids[i]) for i in ids}
    stored = spark.read.parquet(f"{out}/chunks").where("ids is not null")
    assert stored.count() == stored.select("digest").distinct().count() < spark.read.parquet(f"{out}/chunks").count()
    assert spark.read.parquet(f"{out}/manifest").agg(F.sum("n_tokens")).first()[0] == start
    order = [r["doc_id"] for f in sorted(p for p in (tmp_path / "store" / "recipes").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert sorted(order) == sorted(ids)


def test_store_detects_damage(spark, tmp_path, word_bpe):
    out = str(tmp_path / "store")
    token_store.write_store(table(spark, [(1, "some text"), (2, "more text here")]), out, word_bpe, 2)
    bad = spark.read.parquet(f"{out}/chunks").withColumn("digest", F.reverse(F.hex("digest")).cast("binary"))
    bad.write.parquet(str(tmp_path / "bad" / "chunks"))
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{out}/{name}").write.parquet(str(tmp_path / "bad" / name))
    with pytest.raises(Exception, match="differs|missing"):
        token_store.read_summaries(spark, str(tmp_path / "bad")).collect()
    # A document that is gone from the recipes is missed by the manifest.
    spark.read.parquet(f"{out}/chunks").write.parquet(str(tmp_path / "less" / "chunks"))
    spark.read.parquet(f"{out}/manifest").write.parquet(str(tmp_path / "less" / "manifest"))
    spark.read.parquet(f"{out}/recipes").where("doc_id = 1").write.parquet(str(tmp_path / "less" / "recipes"))
    for read in (token_store.read_summaries, token_store.read_ids):
        with pytest.raises(RuntimeError, match="manifest"):
            read(spark, str(tmp_path / "less"))


def test_other_tokenizers_get_whole_texts(word_bpe):
    from tokenizers import Tokenizer

    cased = json.loads(word_bpe)
    cased["normalizer"] = {"type": "NFC"}
    raw = json.dumps(cased)
    encoder, texts = token_store.Encoder(raw), ["A cased TEXT  here", "", "naïve"]
    t = Tokenizer.from_str(raw)
    assert [x.tolist() for x in encoder.encode([x.encode() for x in texts], 2)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert token_store.Encoder(word_bpe).by_word and not encoder.by_word


def test_words_of_letters_need_no_pattern(word_bpe, monkeypatch):
    from tokenizers import Tokenizer

    t, odd = Tokenizer.from_str(word_bpe), ["don't 'LL 'x ''s I'm2 a1b22", "é'RE ×÷ ÀÖß \x7f a\x01b", "<|x|> naïve,Ünder ªµº"]
    want = lambda x: [*t.encode(x, add_special_tokens=False).ids, 2]
    assert [x.tolist() for x in token_store.Encoder(word_bpe).encode([x.encode() for x in odd], 2)] == [want(x) for x in odd]
    monkeypatch.setattr(token_store, "_PIECES", None)
    assert token_store.Encoder(word_bpe).encode([b"Plain Words of letters"], 2)[0].tolist() == want("Plain Words of letters")


def test_store_of_nothing(spark, tmp_path, word_bpe):
    token_store.write_store(table(spark, []), str(tmp_path / "s"), word_bpe, 2)
    assert token_store.read_summaries(spark, str(tmp_path / "s")).count() == 0


def test_chunks_and_crc():
    ids = np.random.RandomState(0).randint(0, 49000, 30_000).astype(np.uint32)
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MAX_CHUNK and sizes[:-1].min() >= token_store.MIN_CHUNK
    moved = token_store.cuts(np.concatenate([ids[:777], ids]))
    assert len({777 + e for e in ends} & set(moved)) > len(ends) // 2  # cuts follow the contents
    a, b = b"first part", b"and the rest of it"
    joined = token_store.shift_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
    assert joined == zlib.crc32(a + b)
