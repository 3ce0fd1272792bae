import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from nearfield.llm import mixing, sharding

from .helpers import BASE, ODD, WORD, table


@pytest.mark.parametrize("part_bytes", [1 << 30, 2000])
def test_shards(spark, tmp_path, part_bytes):
    rows = [(i, f"{BASE} {i}" * (1 + i % 7)) for i in range(400)] + [(1000 + i, "copy " * 30) for i in range(40)] + [(5000, None), (None, "no id")]
    docs = table(spark, rows).withColumn("slot", F.lit("clash"))
    got = sharding.shard(docs, 5, str(tmp_path / "s"), part_bytes=part_bytes).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    size = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    mean = sum(size.values()) / 5
    assert set(size) == set(range(5)) and max(abs(x - mean) for x in size.values()) < 0.03 * mean
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["text"] == "copy " * 30}) == 1  # equal texts stay together where the law allows


def test_a_group_larger_than_a_shard_is_split(spark, tmp_path):
    got = sharding.shard(table(spark, [(i, "the same text for all") for i in range(600)]), 4, str(tmp_path / "s")).groupBy("shard").count().collect()
    assert len(got) == 4 and max(abs(r["count"] - 150) for r in got) <= 2


def test_repeated_rows_are_dealt_out(spark, tmp_path):
    table(spark, [(7, "the same row")] * 600).repartition(3).write.parquet(str(tmp_path / "in"))
    got = sharding.shard(spark.read.parquet(str(tmp_path / "in")), 4, str(tmp_path / "s")).groupBy("shard").count().collect()
    assert len(got) == 4 and max(abs(r["count"] - 150) for r in got) <= 2


def test_many_splitters_take_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_PROBES", 8)
    got = sharding.shard(table(spark, [(i, f"{BASE} {i}") for i in range(400)]), 10, str(tmp_path / "s"), part_bytes=1500).groupBy("shard").agg(F.sum("size").alias("n"), F.count("slot").alias("rows"), F.max("slot").alias("last")).collect()
    assert len(got) == 10 and all(r["last"] == r["rows"] - 1 for r in got) and max(r["n"] for r in got) < 1.05 * min(r["n"] for r in got)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    assert sharding.shard(table(spark, ODD), 40, str(tmp_path / "a")).count() == len(ODD)
    assert sharding.shard(table(spark, []), 3, str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(table(spark, []), 0, str(tmp_path / "c"))


def test_targets():
    assert mixing.capped_targets({"a": 100, "b": 100}, {"a": 1, "b": 1}) == {"a": 100.0, "b": 100.0}
    got = mixing.capped_targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2})
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(210) and got["c"] == pytest.approx(2 * got["b"])


def test_flow_is_cheapest_by_brute_force():
    patterns, quotas = {("a",): 3, ("a", "b"): 2, ("b",): 1}, {"a": 4, "b": 4}
    got = mixing.route(patterns, quotas)

    def cost(n, size):
        return sum(min(max(n - size * r, 0), size) * (r * (r + 1) // 2) for r in range(3))

    def feasible(x):
        only_a, both, only_b = x
        return any(only_a + k <= 4 and only_b + both - k <= 4 for k in range(both + 1))

    best = min((-(sum(x)), sum(cost(n, s) for n, s in zip(x, patterns.values()))) for x in itertools.product(range(10), range(7), range(4)) if feasible(x))
    assert (-(sum(got.values())), sum(cost(got[p], s) for p, s in patterns.items())) == best


def test_mix(spark):
    rows = [(i, "word " * (5 + i % 9), "en", f"s{i % 3}") for i in range(900)] + [(2000 + i, "x y z", "en", None) for i in range(50)] + [(3000, None, "en", "s0"), (3001, "", "en", "s1"), (None, "w", "en", "s2")]
    docs = table(spark, rows).withColumn("taken", F.lit("clash"))
    frame, info = mixing.mix(docs, F.array("source"))
    got, targets = frame.collect(), {r["source_name"]: r["target"] for r in info.collect()}
    assert len(got) == len(rows) and list(targets) == ["s0", "s1", "s2", None]
    taken = {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - t) <= 15 for s, t in targets.items())
    again = mixing.mix(docs.repartition(7), F.array("source"))[0]
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    every = mixing.mixed_documents(docs)
    assert every.columns == docs.columns and every.count() == sum(r["times"] for r in got)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "word " * 10) for i in range(300)]
    members = F.when(F.col("doc_id") < 100, F.array(F.lit("a"))).when(F.col("doc_id") < 200, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    frame, info = mixing.mix(table(spark, rows), members, weights=(1, 1))
    assert sum(r["target"] for r in info.collect()) == pytest.approx(3000)
    assert frame.agg(F.sum("taken")).first()[0] == pytest.approx(3000, abs=30)
    assert mixing.mix(table(spark, []), F.array("source"))[0].count() == 0


def test_mix_of_many_sources_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 3)
    names = ("size", "times", "taken", "pattern", "target", "source_size", "bucket", "hash", "whole", "rest")
    docs = table(spark, [(i, "word " * 10, "en", f"s{i % 40}") for i in range(400)])
    for name in names:
        docs = docs.withColumn(name, F.lit(77))
    every = mixing.mixed_documents(docs)
    assert every.columns == docs.columns and every.where(" or ".join(f"{x} <> 77" for x in names)).count() == 0
    assert every.count() == pytest.approx(400, abs=40)


def test_sizes_are_words(spark):
    got = {r[0]: r[1] for r in table(spark, ODD).select("doc_id", mixing.words_of()).collect()}
    assert got == {r[0]: len(WORD.findall(r[1] or "")) for r in ODD}
    assert zlib.crc32(b"") == 0
