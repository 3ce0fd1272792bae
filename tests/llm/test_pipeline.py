"""The pipeline, stage by stage, on a small corpus with planted cases."""

import hashlib
import random

import public_tokenizers
import pytest

from .helpers import SPACE, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(spark, at):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            text[10] = text[30] = "vile"
        rows.append((i, " ".join(text), "en", f"s{i % 3}"))
        labels.append((i, int(toxic)))
    copy, near = rows[1][1], rows[2][1].split()
    near[0] = "changed"
    rows += [(1001, copy.replace(" ", "  "), "en", "s0"), (1002, " ".join(near), "fr", None), (1003, None, None, None), (1004, "", "en", "s1")]
    table(spark, rows).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = {r[0]: r for r in corpus(spark, tmp_path)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        after = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert after.columns == docs.columns
        kept.append([r["doc_id"] for r in after.collect()])
        docs = after
    toxic = {i for i in rows if i < 240 and i % 6 == 0}
    assert not toxic & set(kept[0]) and len(kept[0]) == len(rows) - len(toxic)
    assert set(kept[0]) - set(kept[1]) == {1001, 1004} and len(kept[1]) == len(set(kept[1]))
    assert set(kept[1]) - set(kept[2]) == {1002}
    assert set(kept[3]) <= set(kept[2]) and sorted(kept[3]) == sorted(kept[4])
    import tiktoken

    from nearfield.llm.byte_bpe import load_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in docs.collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["n_tokens"] == len(library.encode_ordinary(text)) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert SPACE.sub(" ", rows[1001][1]) == rows[1][1]


def test_run_and_names(spark, tmp_path):
    corpus(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages_hand_the_drivers_memory_back(spark, tmp_path, monkeypatch):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def collections() -> int:
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    def freed(module, stage) -> list[bool]:
        seen, give_back = [], module.give_back

        def watched(*args):
            before = collections()
            give_back(*args)
            seen.append(collections() > before)

        monkeypatch.setattr(module, "give_back", watched)
        stage(spark, docs, str(tmp_path))
        return seen

    stages = dict(corpus_pipeline.STAGES)
    # The JVM's too: before the model is fitted and after, and in every round of comparisons.
    assert freed(corpus_pipeline.toxicity, stages["toxicity"]) == [True] * 2
    near = freed(corpus_pipeline.jaccard_join, stages["n-gram Jaccard join"])
    assert len(near) > 4 and all(near)
