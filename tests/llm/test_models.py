"""Jaccard join, language model, vector search and toxicity against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import common, jaccard_join, katz, toxicity, vector_search

from .helpers import BASE, ODD, table, words


def plain_components(rows, n=4, numer=85, denom=100):
    sets = {}
    for i, text in ((r[0], r[1]) for r in rows):
        w = words(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and denom * both >= numer * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for group in range(12):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            text = list(body)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if group % 2:
                text = text + passage
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, rows).repartition(3)).collect()}
    assert got == plain_components(rows)


def test_components_with_skipping_forced(spark, monkeypatch):
    """Answers of leaders decide about members: no round may connect everything first."""
    monkeypatch.setattr(jaccard_join, "SHORT", 1)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    rows = near_copies(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_sketches_exclude_sets_below_the_bound():
    """Sets of 600 with a similarity of 0.8 are told from links of 0.85 without a comparison; linked ones never are."""
    rng = np.random.default_rng(5)
    for shared, linked in ((534, False), (552, True)):
        every = np.unique(rng.integers(0, 1 << 63, 1400, np.int64).astype(np.uint64))
        x, y = every[:600], np.append(every[600 - shared : 600], every[600 : 1200 - shared])
        one = np.zeros(1, np.int64)
        for most in (1 << 62, 2048):
            differ = jaccard_join.differences([jaccard_join.sketch(x, most)], one, [jaccard_join.sketch(y, most)], one)[0]
            assert ((1200 - differ) // 2 >= jaccard_join.least_overlap(600, 600, 85, 100)) == linked


def test_candidates_are_all_pairs_that_the_bounds_allow():
    rng = np.random.default_rng(6)
    group = np.repeat([3, 4, 9], [200, 1, 90])
    size = np.concatenate([np.sort(rng.integers(1, 400, n)) for n in (200, 1, 90)])
    place = rng.integers(0, 1 + size // 6)
    found = {(i, j) for i, j in zip(*(np.concatenate(x) for x in zip(*jaccard_join.candidates(group, size, place, np.ones(291, bool), 85, 100)))) if jaccard_join.allowed(size[i], place[i], size[j], place[j], 85, 100)}
    i, j = np.triu_indices(291, 1)
    good = (group[i] == group[j]) & jaccard_join.allowed(size[i], place[i], size[j], place[j], 85, 100)
    assert found == set(zip(i[good], j[good]))


def test_order_counts_shingles_that_repeat_only_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COUNT_BLOCK", 1)
    docs = table(spark, [(i, "a passage that all hold") for i in range(64)] + [(100, "else")]).repartition(8)
    levels = jaccard_join.global_order(jaccard_join.describe(docs, 4).where("kind = 1").select("a", "sketch"))
    assert sorted(levels[levels > 0].tolist()) == [48, 48]


def test_components_of_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 2]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, rows)).collect()}
    assert got == plain_components(rows)
    null = jaccard_join.jaccard_components(table(spark, [(None, BASE), (1, BASE), (2, BASE)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in null) == [("1", 1), ("2", 1), ("None", None)]
    assert jaccard_join.jaccard_components(table(spark, [])).count() == 0
    kept = jaccard_join.one_of_each(table(spark, [(None, BASE), (3, BASE), (4, BASE), (5, "else")]).withColumn("label", F.lit(1)))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "5", "None"] and kept.columns[-1] == "label"


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (9, 9)], "a bigint, b bigint")
    got = dict(tuple(r) for r in common.components(edges).collect())
    assert got == {**dict.fromkeys(range(100, 141), 100), 3: 3, 7: 3}


def test_a_grown_heap_goes_back(spark):
    jvm, kept = spark._jvm, spark._jvm.java.util.ArrayDeque()
    for _ in range(300):
        kept.add(jvm.java.lang.StringBuilder(1 << 20))
    runtime = jvm.java.lang.Runtime.getRuntime()
    grown = runtime.totalMemory()
    kept.clear()
    common.give_back(spark)
    total, free = runtime.totalMemory(), runtime.freeMemory()
    assert total < grown and free < 0.4 * total  # Java's own bound is 70 per cent


def test_word_hashes_are_those_of_whole_words(monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 64)
    texts = ["a bb  ccc", "", "A BB\tccc\n", "x" * 300 + " y", "é bb", "  ", "bb" * 40 + " " * 100 + "a"]
    import pyarrow as pa

    h, first = common.hash_words(*common.text_bytes(pa.array([*texts, None])))
    split = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(s) for s in split] == [len(words(t)) for t in texts] + [0]
    assert split[0] == split[2] and split[4][1] == split[0][1] and split[6][1] == split[0][0]
    assert len({x for s in split for x in s}) == len({w for t in texts for w in words(t)})


def plain_katz(rows):
    texts = {r[0]: [*words(r[1]), "</s>"] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    uni, pairs = Counter(), defaultdict(Counter)
    for i, t in texts.items():
        if not held[i]:
            uni.update(t)
            for h, w in zip(["<s>", *t], t):
                pairs[h][w] += 1
    total = sum(uni.values())
    by = Counter(uni.values())
    one = katz.Unigrams(total, dict(by), sum(c for c in uni.values() if c > katz.LIMIT))
    p1 = lambda w: float(one.of(np.array([uni[w]]))[0])
    by = Counter(c for x in pairs.values() for c in x.values())
    d = katz.discounts([by[r] for r in range(1, katz.LIMIT + 2)])
    kept = lambda c: d[c - 1] * c if c <= katz.LIMIT else c

    def model(h):
        n = sum(pairs[h].values())
        left, scale = 1 - sum(map(kept, pairs[h].values())) / n, 1.0
        if left < 1e-12:
            left, scale = 1 / (n + 1), n / (n + 1)
        alpha = left / (1 - sum(map(p1, pairs[h])))
        known = sum(scale * kept(c) / n for c in pairs[h].values())
        assert known + alpha * (1 - sum(map(p1, pairs[h]))) == pytest.approx(1)
        return n, scale, alpha

    models = {h: model(h) for h in list(pairs)}
    assert sum(map(p1, uni)) + one.unknown == pytest.approx(1)
    out = {}
    for i, t in texts.items():
        score = 0.0
        for h, w in zip(["<s>", *t], t):
            n, scale, alpha = models.get(h, (0, 1.0, 1.0))
            score += math.log10(scale * kept(pairs[h][w]) / n if h in models and pairs[h][w] else alpha * p1(w))
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t)
        out[i] = (held[i], len(t), sum(uni[w] > 0 for w in t), total, base, score)
    return out


@pytest.mark.parametrize("head, bucket", [(1 << 18, 3_000_000), (8, 50)])
def test_katz_matches_plain_version(spark, monkeypatch, head, bucket):
    monkeypatch.setattr(katz, "HEAD", head)
    monkeypatch.setattr(katz, "BUCKET_EVENTS", bucket)
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) if rng.random() < 0.7 else "the same" for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "A a\ta"), (103, "word " * 3000)]
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.score(table(spark, rows).repartition(3)).collect()}
    want = plain_katz(rows)
    assert set(got) == set(want)
    for i, x in want.items():
        assert got[i][:4] == x[:4] and got[i][4:] == pytest.approx(x[4:], rel=1e-9)


def test_katz_moves_as_much_in_many_buckets(spark):
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(5000)]
    docs = table(spark, [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(2000)]).coalesce(1)
    rows = katz.keyed(docs)
    counts = katz.unigram_counts(rows).toPandas()
    counts["w"] = counts["w"].to_numpy(np.int64).view(np.uint64)
    counts = counts.sort_values("w")
    head, hot = (counts["w"].to_numpy(), counts["c"].to_numpy()), np.array([katz.START])
    model = katz.Unigrams(int(head[1].sum()), dict(Counter(int(c) for c in head[1] if c <= katz.LIMIT)), int(head[1][head[1] > katz.LIMIT].sum()))

    def moved(buckets: int) -> int:
        packed = katz.staged(katz.events(rows, head, hot, buckets), "events")
        sums = katz.counted(packed, head, hot, np.array([1700]), model).where("kind = 0").select("sums").collect()
        binary = [c for c, kind in packed.dtypes if kind == "binary"]
        return sum(len(x) for r in packed.select(*binary).collect() for x in r) + sum(len(r["sums"]) for r in sums)

    assert moved(200) < 4 * 400_000  # 12.7 bytes an event before, 1.6 now


def test_katz_pieces_keep_texts_apart():
    key = np.array([5, 3, 4, (1 << 31) + 7, (1 << 40) + 1, (1 << 40) + 2])
    batches = [pa.RecordBatch.from_pydict({"key": key[:2], "text": ["a", None]}), pa.RecordBatch.from_pydict({"key": key[2:], "text": ["b"] * 4})]
    assert [p.column("key").to_pylist() for p in katz.gathered(iter(batches), 1 << 20)] == [[5, 3, 4], [(1 << 31) + 7], [(1 << 40) + 1, (1 << 40) + 2]]
    assert [p.column("key").to_pylist() for p in katz.gathered(iter(batches), 1)][-1] == [(1 << 40) + 2]
    packer, unpacker = katz.zstandard.ZstdCompressor(), katz.zstandard.ZstdDecompressor()
    arrays = [np.array(x, k) for x, k in (([], "u8"), ([1, 2**31, 7], "u4"), ([2**63, 1], "u8"), ([9], "u1"))]
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, katz.unpacked_arrays(katz.packed_arrays(arrays, packer), 4, unpacker)))


def test_katz_of_repeated_rows_and_nothing(spark):
    twice = katz.score(table(spark, [(1, "a b"), (1, "a b"), (2, "a c"), (None, "a")])).collect()
    assert len(twice) == 4 and len({tuple(r) for r in twice if r["doc_id"] == 1}) == 1
    assert katz.score(table(spark, [])).count() == 0
    unheld = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.score(table(spark, [(unheld, "no training text")])).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == 0.0


def test_vector_search_recall_and_order(spark):
    x = np.random.RandomState(1).normal(size=(3000, 30)) * np.random.RandomState(2).gamma(2, 1, (3000, 1))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)
    got = vector_search.search(rows, rows.where("vec_id % 100 = 0"), 10, rerank=60).collect()
    x = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert np.allclose([m[2] for m in mine], s[[m[1] for m in mine]], rtol=1e-12)
        hits += len({m[1] for m in mine} & set(np.argsort(-s)[:10].tolist()))
    assert hits / 300 >= 0.9


def test_vector_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [-1.0, 0.5, 0.0]), (7, [1.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0, 0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_search.search(frame, frame, 20).collect()
    assert {r["query_id"] for r in got} == {0, 1, 6, 8}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1] == [0, 8, 6]
    assert vector_search.search(frame.limit(0), frame.limit(0), 5).count() == 0


def test_anisotropic_loss_prefers_small_parallel_error():
    x = np.random.RandomState(3).normal(size=(500, 8))
    book = vector_search.train(x)
    parallel = {}
    for eta in (1.0, vector_search.ETA):
        codes = vector_search.assign(x, book.centroids, eta)
        decoded = book.centroids[np.arange(book.pairs), codes].reshape(500, -1)[:, :8]
        parallel[eta] = ((((x - decoded) * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean()
    assert parallel[vector_search.ETA] < parallel[1.0]


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    clean = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(clean) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["Vile!", "awful,"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, known)).collect()}
    test = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in test) / len(test) > 0.95
    kept = toxicity.clean_documents(docs.withColumn("score", F.lit("clash")), known)
    assert kept.columns == [*docs.columns, "score"] and kept.where("score = 'clash'").count() == kept.count() >= 470


def test_toxicity_of_odd_rows_and_missing_labels(spark):
    docs = table(spark, ODD)
    none = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, none)
    assert model.bias is None
    assert [r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()] == [0.0] * len(ODD)
    some = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int"))
    scores = [r["score"] for r in toxicity.score(docs, some).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(table(spark, []), some).count() == 0


def test_packed_features_are_unpacked_only_when_asked_for():
    import zstandard

    rows = [np.array([3, 7, 8], np.int32), np.zeros(0, np.int32)]
    packed = toxicity.Packed([zstandard.ZstdCompressor().compress(np.diff(r, prepend=0).astype(np.int32).tobytes()) for r in rows])
    assert [x.tolist() for x in packed] == [[3, 7, 8], []] == [x.tolist() for x in packed] and len(packed) == 2
    assert all(isinstance(x, bytes) for x in packed.rows)
