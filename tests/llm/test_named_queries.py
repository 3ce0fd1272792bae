"""Every opN_ query, whole, on a small table with odd rows, against plain versions."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from nearfield.llm import queries
from nearfield.llm.exact_dedup import SQL
from nearfield.llm.toxicity import PAIR_PENALTY, SPACE_SIZE, WORD_BITS, train

from .helpers import BASE, ODD, WORD, table, words
from .test_models import plain_components, plain_katz

TEXTS = [r for r in ODD if r[0] not in (2, 9)] + [(2, "A b c")] + [(100 + i, f"{BASE} and item {i % 6}", "en", f"s{i % 4}") for i in range(40)] + [(200 + i, " ".join(f"w{(i * j) % 37}" for j in range(25)), "fr", None) for i in range(40)]
IDS = [r[0] for r in TEXTS]
TEXT = {r[0]: r[1] or "" for r in TEXTS}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    table(spark, TEXTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in IDS], "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    x = np.random.RandomState(3).normal(size=(900, 24)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at


def rows(spark, folder, name):
    found = queries.queries()[name](spark, folder).collect()
    if "doc_id" in found[0].asDict():
        assert sorted(r["doc_id"] for r in found) == sorted(IDS)
    return found


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.sql(SQL)
    got = [tuple(r[c] for c in want.columns) for r in rows(spark, folder, "op1_exact_dedup")]
    assert sorted(got) == sorted(want.fetchall())


def test_op2(spark, folder):
    assert all((r["n_tokens"] == 0) == (TEXT[r["doc_id"]] == "") for r in rows(spark, folder, "op2_token_counts"))


def test_op3(spark, folder):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, folder, "op3_byte_bpe"):
        ids = library.encode_ordinary(TEXT[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(TEXT[r["doc_id"]].encode()))


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, folder, "op4_token_store")}
    for i in sorted(IDS):
        ids = [*t.encode(TEXT[i], add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, folder):
    got = rows(spark, folder, "op5_sharding")
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(TEXT[r["doc_id"]].encode()) + 16, zlib.crc32(TEXT[r["doc_id"]].encode()), "bytes", None)
    for s in {r["shard"] for r in got}:
        assert 0 <= s < 40 and sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_op6(spark, folder):
    want = plain_components(TEXTS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, folder, "op6_ngram_jaccard")} == want


def test_op7(spark, folder):
    want = plain_katz(TEXTS)
    for r in rows(spark, folder, "op7_katz_lm"):
        x = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:4] and (r["base_score"], r["score"]) == pytest.approx(x[4:], rel=1e-9)


@pytest.mark.parametrize("where", ["small", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op8_recall_by_brute_force(spark, folder, where):
    at = folder if where == "small" else where
    if not os.path.isdir(at):
        pytest.skip("needs the test tables")
    every = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in every]), np.array([r[1] for r in every], np.float64)
    got: dict = {}
    for r in queries.queries()["op8_anisotropic_ann"](spark, at).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = np.array([float(np.cumsum(v * x[ids == q][0])[-1]) for v in x])
        truth = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits += len({i for _, i, _ in found} & set(truth))
        place = {i: s for i, s in zip(ids, scores)}
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s == place[i] for _, i, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
    assert hits / (20 * len(got)) >= 0.95


def test_op9(spark, folder):
    for r in rows(spark, folder, "op9_toxicity"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_ftrl_against_a_plain_version():
    """The recurrences, coordinate by coordinate."""
    rng = np.random.RandomState(2)
    data = [np.unique(rng.choice([3, 5, 8, 1 << WORD_BITS, (1 << WORD_BITS) + 9], 3)).astype(np.int32) for _ in range(60)]
    y = np.array([float(3 in x) for x in data])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 1.0
    z, n = {}, {}

    def weight(i):
        penalty = 0.0 if i == SPACE_SIZE else l1 * (PAIR_PENALTY if i >= 1 << WORD_BITS else 1)
        if abs(z.get(i, 0.0)) <= penalty:
            return 0.0
        return -(z[i] - np.sign(z[i]) * penalty) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for x, label in zip(data, y):
            at = [*x.tolist(), SPACE_SIZE]
            w = [weight(i) for i in at]
            g = (1 / (1 + np.exp(-sum(w))) - label) * (0.5 / y.mean() if label else 0.5 / (1 - y.mean()))
            for i, wi in zip(at, w):
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / alpha * wi
    model = train(data, y, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2)
    want = {i: weight(i) for i in z if i != SPACE_SIZE and weight(i)}
    assert dict(zip(model.at.tolist(), model.weight.tolist())) == pytest.approx(want) and model.bias == pytest.approx(weight(SPACE_SIZE))


def test_op10(spark, folder):
    got = rows(spark, folder, "op10_source_mixing")
    source = {r[0]: (r[3] if len(r) > 3 else "a") for r in TEXTS}
    sizes: dict = {}
    for i in IDS:
        sizes[source[i]] = sizes.get(source[i], 0) + len(WORD.findall(TEXT[i]))
    order = sorted(s for s in sizes if s is not None) + [None]
    free, target, total = set(order), {}, sum(sizes.values())
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.remove(s)
    target |= share
    taken: dict = {}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (len(words(TEXT[r["doc_id"]])), sizes[s]) and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    most = max(len(WORD.findall(t)) for t in TEXT.values())
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    assert sorted((r["doc_id"], r["taken"]) for r in rows(spark, folder, "op10_source_mixing")) == sorted((r["doc_id"], r["taken"]) for r in got)
