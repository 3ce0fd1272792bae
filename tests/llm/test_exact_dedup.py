import hashlib

from pyspark.sql import functions as F

from nearfield.llm.exact_dedup import PLACE, exact_dedup, kept_documents

from .helpers import ODD, SPACE, table


def plain(rows):
    norm = [(r[0], SPACE.sub(" ", r[1] or "")) for r in rows]
    best, size = {}, {}
    for i, t in norm:
        best[t] = min(best.get(t, i), i)
        size[t] = size.get(t, 0) + 1
    return sorted((i, best[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def got(frame):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in frame.collect())


def test_matches_brute_force_over_several_micro_batches(spark, tmp_path):
    table(spark, ODD).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = exact_dedup(docs, files_per_batch=1)
    assert got(found) == plain(ODD)
    kept = found.where("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count()


def test_colliding_digests_do_not_merge_texts(spark):
    rows = [(i, f"text {i % 5}") for i in range(30)]
    weak = exact_dedup(table(spark, rows), digest=F.substring("sha", 1, 0))
    assert got(weak) == plain(rows)


def test_large_group_is_compared_with_copies_of_its_keeper(spark):
    rows = [(i, "same text") for i in range(1000)] + [(2000, "other")]
    assert got(exact_dedup(table(spark, rows))) == plain(rows)


def test_null_ids_come_last_and_other_columns_stay(spark):
    rows = table(spark, [(None, "a"), (3, "a"), (None, "b"), (None, "b")]).withColumn("digest", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("n", F.lit(3))
    found = exact_dedup(rows)
    assert {"digest", "slot", "n"} < set(found.columns)
    assert sorted((r["keep_id"] is None, r["kept"]) for r in found.collect()) == [(False, False), (False, True), (True, False), (True, True)]
    kept = kept_documents(rows)
    assert kept.columns == rows.columns and kept.count() == 2


def test_empty_table(spark):
    found = exact_dedup(table(spark, []))
    assert found.count() == 0 and set(PLACE) < set(found.columns)


def test_state_outlives_the_call(spark, tmp_path):
    table(spark, [(5, "a  b"), (6, "c"), (7, "a b")]).write.parquet(str(tmp_path / "one"))
    table(spark, [(2, "a b"), (8, "c"), (9, "d"), (10, "d")]).write.parquet(str(tmp_path / "two"))
    state = str(tmp_path / "state")
    first = exact_dedup(spark.read.parquet(str(tmp_path / "one")), state=state).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in first} == {5: (5, 2, True), 7: (5, 2, False), 6: (6, 1, True)}
    second = exact_dedup(spark.read.parquet(str(tmp_path / "two")), state=state).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in second} == {2: (2, 3, True), 8: (6, 2, False), 9: (9, 2, True), 10: (9, 2, False)}


def test_clashing_columns(spark):
    docs = table(spark, [(1, "x"), (2, "x"), (3, "y")])
    for name in ("kept", "keep_id", "group_size", "text_sha256", "digest", "slot", "keeper", "n"):
        docs = docs.withColumn(name, F.lit(f"user's {name}"))
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and {(r["doc_id"], r["kept"], r["n"]) for r in kept.collect()} == {(i, "user's kept", "user's n") for i in (1, 3)}
    out = exact_dedup(docs)
    assert len(set(out.columns)) == len(out.columns)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in out.collect()} == {(1, 1, 2, True, "user's digest"), (2, 1, 2, False, "user's digest"), (3, 3, 1, True, "user's digest")}
