"""Segments, the collection and its files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.database import Database
from nearfield.operators import evaluate, flat, hnsw, segments
from nearfield.sources import binary, collection, shared


def vectors(spark, n, dim=4, start=0):
    return spark.createDataFrame([(i, [float(i)] + [0.0] * (dim - 1)) for i in range(start, start + n)], "user_id bigint, embedding array<float>")


def found(frame):
    return [(r["user_id"], r["distance"]) for r in frame.collect()]


def test_flat_topk(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 0.0])], "user_id bigint, embedding array<float>")
    assert found(flat.flat_topk(rows, [0, 0], 3)) == [(0, 0.0), (2, 1.0), (1, 25.0)]
    assert found(flat.flat_topk(rows, [0, 0], 10)) == found(flat.flat_topk(rows, [0, 0], 3))
    assert found(flat.flat_topk(rows, [0, 0], 0)) == [] == found(flat.flat_topk(rows.limit(0), [0, 0], 3))
    tied = spark.createDataFrame([(5, [1.0]), (3, [-1.0]), (4, [1.0])], "user_id bigint, embedding array<float>")
    assert [i for i, _ in found(flat.flat_topk(tied, [0], 2))] == [3, 4]


def test_batch_forms_agree(spark):
    x = np.random.RandomState(1).normal(size=(300, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "user_id bigint, embedding array<float>").repartition(3)
    q = rows.where("user_id < 7").select(F.col("user_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(flat.knn_batch(q, rows, 5).collect())
    assert want == sorted(flat.knn_arrow(spark, q, rows, 5).collect())
    assert want == sorted(segments.segmented_knn(q, segments.assign(rows, 70), 5).collect())
    assert flat.knn_arrow(spark, q.limit(0), rows, 5).count() == 0


def test_ordinals_are_dense_over_many_partitions(spark):
    got = segments.assign(vectors(spark, 57).repartition(5), 10).orderBy("user_id").collect()
    assert [(r["ordinal"], r["segment_id"], r["offset"]) for r in got] == [(i, i // 10, i % 10) for i in range(57)]
    mapping = segments.id_mapping(segments.assign(vectors(spark, 20, start=1000), 100))
    wanted = spark.createDataFrame([(1003,), (5,)], "user_id bigint")
    assert sorted((r["user_id"], r["offset"]) for r in segments.id_lookup(mapping, wanted).collect()) == [(5, None), (1003, 3)]
    place = spark.createDataFrame([(0, 7), (0, 99)], "segment_id bigint, offset bigint")
    assert sorted((r["offset"], r["user_id"]) for r in segments.user_of(mapping, place).collect()) == [(7, 1007), (99, None)]


def test_graph_frames(spark):
    x = np.random.RandomState(2).normal(size=(120, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "user_id bigint, embedding array<float>")
    nodes = shared.staged(hnsw.build(segments.assign(rows, 50)), "test", **hnsw.WRITE)
    assert tuple(hnsw.invariants(nodes).first()) == (0, 0, 0)
    assert all(r["nodes"] == r["reached"] for r in hnsw.reachable(nodes).collect())
    q = [(i, x[i]) for i in range(5)]
    exact = flat.knn_batch(spark.createDataFrame([(i, v.tolist()) for i, v in q], "query_id bigint, q array<float>"), rows, 4)
    assert sorted(hnsw.search(q, nodes, 4).collect()) == sorted(exact.collect())
    assert evaluate.mean_recall(hnsw.search(q, nodes, 4), exact, 4) == 1.0
    swept = evaluate.sweep(lambda ef: hnsw.search(q, nodes, 4, hnsw.HnswSearchParams(ef)), [4, 32], exact, 4, warm=False)
    assert evaluate.gate(swept, 4) and "recall_at_4" in evaluate.report(swept) and evaluate.machine()["cpus"]


def test_lazy_seal_and_search_across_segments(spark):
    db = Database(spark, 4, 3)
    assert found(db.search([0, 0, 0, 0], 3)) == [] and db.segment_count == 1
    db.insert(vectors(spark, 3))
    assert (db.segment_count, db.size) == (1, 3)
    db.insert(10, [0, 0, 0, 0])
    assert (db.segment_count, db.size, db.dimensions) == (2, 4, 4)
    db.insert_batch([11], [[1, 0, 0, 0]])
    assert found(db.search([0, 0, 0, 0], 3)) == [(0, 0.0), (10, 0.0), (1, 1.0)]
    for bad in (lambda: db.insert(10, [0, 0, 0, 0]), lambda: db.insert(1, [0, 0, 0, 0]), lambda: db.insert_batch([20, 20], [[0] * 4] * 2), lambda: db.insert(30, [1, 2]), lambda: db.search([1, 2], 1), lambda: db.insert(vectors(spark, 1, dim=3, start=90)), lambda: db.insert(-1, [0] * 4)):
        with pytest.raises(ValueError):
            bad()
    assert db.size == 5
    for bad in ((0, 3), (4, 0)):
        with pytest.raises(ValueError):
            Database(spark, *bad)
    with pytest.raises(RuntimeError):
        db.save()


def test_save_load_and_crash(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(spark, 4, 5, path)
    db.insert(vectors(spark, 12))
    assert db.segment_count == 3
    crashed = Database.load(spark, path)
    assert crashed.size == 10 and crashed.segment_count == 3
    with pytest.raises(ValueError):
        crashed.insert(9, [0, 0, 0, 0])
    before = found(db.search([2.2, 0, 0, 0], 5))
    db.save()
    again = Database.load(spark, path)
    assert (again.size, again.segment_count) == (12, 4) and found(again.search([2.2, 0, 0, 0], 5)) == before
    again.insert(vectors(spark, 1, start=50))
    db.save()
    assert Database.load(spark, path).size == 12
    with pytest.raises(RuntimeError):
        Database(spark, 4, 5, path)
    (tmp_path / "db" / ".manifest.json.stray.tmp").write_text("torn")
    assert Database.load(spark, path).size == 12


@pytest.mark.parametrize("change", [{"format_version": 2}, {"dim": None}, {"dim": -1}, {"m": 2**64}, {"segment_count": 9}, {"dim": 3}, {"m": 1}])
def test_manifest_rejections(spark, tmp_path, change):
    path = str(tmp_path / "db")
    db = Database(spark, 4, 5, path)
    db.insert(vectors(spark, 3))
    db.save()
    at = tmp_path / "db" / "manifest.json"
    good = json.loads(at.read_text())
    at.write_text(json.dumps({k: v for k, v in {**good, **change}.items() if v is not None}))
    for crc in (tmp_path / "db").glob(".manifest.json.crc"):
        crc.unlink()
    with pytest.raises(RuntimeError):
        Database.load(spark, path)
    at.write_text("{")
    with pytest.raises(RuntimeError):
        Database.load(spark, path)
    with pytest.raises(RuntimeError):
        Database.load(spark, str(tmp_path / "nothing"))


def test_empty_collection_round_trip(spark, tmp_path):
    db = Database(spark, 4, 5, str(tmp_path / "db"))
    db.save()
    assert Database.load(spark, str(tmp_path / "db")).size == 0


def test_binary_files(spark, tmp_path):
    binary.register(spark)
    rows = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(9)], "offset bigint, embedding array<float>")
    for kind in ("vecbin", "fvecs"):
        at = str(tmp_path / f"x.{kind}")
        rows.orderBy("offset").write.format(kind).mode("append").save(at)
        assert sorted(spark.read.format(kind).load(at).collect()) == sorted(rows.collect())
    ids = rows.select("offset", (F.col("offset") + 2**40).alias("user_id"))
    ids.orderBy("offset").write.format("idbin").mode("append").save(str(tmp_path / "ids"))
    assert sorted(spark.read.format("idbin").load(str(tmp_path / "ids")).collect()) == sorted(ids.collect())
    ints = rows.select("offset", F.array(F.col("offset").cast("int"), F.lit(7)).alias("embedding"))
    ints.orderBy("offset").write.format("ivecs").mode("append").save(str(tmp_path / "i"))
    assert sorted(spark.read.format("ivecs").load(str(tmp_path / "i")).collect()) == sorted(ints.collect())
    nodes = hnsw.nodes(hnsw.build(segments.assign(vectors(spark, 30), 30))).select("offset", "level", "entry", "links")
    top = nodes.where("entry").first()
    nodes.orderBy("offset").write.format("graphbin").options(m=16, max_level=top["level"], entry_point=top["offset"]).mode("append").save(str(tmp_path / "g"))
    assert sorted(spark.read.format("graphbin").load(str(tmp_path / "g")).collect()) == sorted(nodes.collect())
    raw = (tmp_path / "x.vecbin").read_bytes()
    for bad in (b"\0" * 16, raw[:10], raw[:20]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(Exception, match="magic|shorter|truncated"):
            spark.read.format("vecbin").load(str(tmp_path / "bad")).collect()
    assert not [p for p in os.listdir(tmp_path) if ".part-" in p]


def test_streaming_ingest(spark, tmp_path):
    from nearfield.streaming.ingest import ingest

    vectors(spark, 8).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    db = Database(spark, 4, 5)
    ingest(stream, db, str(tmp_path / "checkpoint")).awaitTermination()
    assert db.size == 8 and found(db.search([7, 0, 0, 0], 1)) == [(7, 0.0)]


def test_large_tables_keep_every_row(spark, tmp_path):
    """More rows a range than the sampler takes, from several files, with the embedding kept."""
    rows = spark.range(100_000).select((F.col("id") * 37 % 100_003).alias("user_id"), F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    rows.repartition(7).write.parquet(str(tmp_path / "in"))
    placed = segments.assign(spark.read.parquet(str(tmp_path / "in")), 1000)
    n, distinct, last, size = placed.agg(F.count("embedding"), F.countDistinct("ordinal"), F.max("ordinal"), F.max(F.size("embedding"))).first()
    assert (n, distinct, last, size) == (100_000, 100_000, 99_999, 2)
    assert placed.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("o")).where("n <> 1000 or o <> 999").count() == 0


def test_insert_keeps_every_row(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("user_id"), F.array((F.col("id") % 97).cast("float"), F.col("id").cast("float")).alias("embedding")).repartition(5)
    db = Database(spark, 2, 500, str(tmp_path / "db"), build_params=hnsw.HnswBuildParams(4, 10))
    db.insert(rows.where("user_id < 5700"))
    db.insert(rows.where("user_id >= 5700"))
    assert (db.size, db.segment_count) == (6000, 12)
    assert db.vectors().distinct().count() == 6000 and db.ids().where("segment_id is not null").groupBy("segment_id").count().where("count <> 500").count() == 0
    assert db.get(3) == [3.0, 3.0] and db.get(5999) == [82.0, 5999.0] and db.get(6000) is None
    assert db.get_at(2, 7) == [37.0, 1007.0] and db.get_at(2, 500) is None and db.get_at(99, 0) is None
    assert len([p for p in os.listdir(tmp_path / "db") if p.startswith("batch")]) == 1  # the rows that are active
    plan = hnsw.search([(0, [1.0, 1.0])], db.segments(), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")  # only what the segments found moves


def test_binary_collection_round_trip(spark, tmp_path):
    x = np.random.RandomState(6).normal(size=(230, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "user_id bigint, embedding array<float>")
    db = Database(spark, 8, 100)
    db.insert(rows)
    at = str(tmp_path / "binary")
    db.export_binary(at)
    assert {"hnsw.bin", "ids.bin", "vectors.bin"} <= set(os.listdir(f"{at}/segment_2")) and json.loads(open(f"{at}/segments.json").read())["segment_count"] == 3
    binary.register(spark)
    assert spark.read.format("vecbin").load(f"{at}/segment_1/vectors.bin").count() == 100
    again = Database.import_binary(spark, at, str(tmp_path / "db"))
    assert (again.size, again.segment_count, again.dimensions) == (230, 4, 8)
    q = [(i, x[i]) for i in range(6)]
    exact = flat.knn_batch(spark.createDataFrame([(i, v.tolist()) for i, v in q], "query_id bigint, q array<float>"), rows, 5)
    assert sorted(again.search_batch(q, 5).collect()) == sorted(exact.collect())
    assert Database.load(spark, str(tmp_path / "db")).size == 230
    with pytest.raises(RuntimeError):
        db.export_binary(at)
    for damage in (lambda p: p.unlink(), lambda p: p.write_bytes(p.read_bytes()[:40]), lambda p: p.write_bytes(b"xxxx" + p.read_bytes()[4:])):
        for crc in (tmp_path / "binary").glob("segment_0/.*.crc"):
            crc.unlink()
        damage(tmp_path / "binary" / "segment_0" / "hnsw.bin")
        with pytest.raises(Exception, match="missing|truncated|magic|shorter"):
            Database.import_binary(spark, at)
        other = Database(spark, 8, 100)
        other.insert(rows)
        import shutil

        shutil.rmtree(at)
        other.export_binary(at)
    registry = tmp_path / "binary" / "segments.json"
    good = json.loads(registry.read_text())
    for change in ({"format_version": 2}, {"dim": 9}, {"segment_count": 4}, {"m": -1}):
        registry.write_text(json.dumps({**good, **change}))
        for crc in (tmp_path / "binary").glob(".segments.json.crc"):
            crc.unlink()
        with pytest.raises(Exception, match="segments.json|missing|dimension|version"):
            Database.import_binary(spark, at)
    assert collection.REGISTRY == "segments.json"


def test_bulk_insert_and_searches(spark, tmp_path):
    """Many rows of 128 dimensions into several segments, then many searches: recall against the exact scan."""
    x = np.random.RandomState(8).uniform(-1, 1, (2000, 128)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "user_id bigint, embedding array<float>")
    db = Database(spark, 128, 500)
    db.insert(rows)
    q = [(i, x[i] + 0.01) for i in range(100)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in q], "query_id bigint, q array<float>")
    assert evaluate.mean_recall(db.search_batch(q, 10), flat.knn_arrow(spark, frame, rows, 10), 10) > 0.95
