"""Named queries over the table embeddings(vec_id, embedding, label), with SQL of the same rows.

Searches take every row whose vec_id is divisible by 50 as a query, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.database import queries_of
from nearfield.functions.vectors import checked
from nearfield.operators import evaluate, flat, hnsw, segments, sq8
from nearfield.sources.shared import staged

K, CAPACITY, STRIDE = 10, 100, 50
Query = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    dim = table.select(F.size("embedding")).first()
    return table.select(F.col("vec_id").alias("user_id"), checked(F.col("embedding"), dim[0] if dim else 0).alias("embedding"))


def query_set(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("user_id") % STRIDE == 0).select(F.col("user_id").alias("query_id"), F.col("embedding").alias("q"))


def _rounded(found: DataFrame) -> DataFrame:
    out = found.withColumn("distance", F.round("distance", 6))
    return out.withColumn("rank", F.col("rank").cast("bigint")) if "rank" in found.columns else out


def l2_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _rounded(flat.l2_pairs(query_set(v), v))


def flat_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    first = v.orderBy("user_id").select("embedding").first()
    return _rounded(flat.flat_topk(v, first[0] if first else [], K))


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _rounded(flat.knn_batch(query_set(v), v, K))


def knn_arrow(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _rounded(flat.knn_arrow(spark, query_set(v), v, K))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return segments.assign(vectors(spark, d), CAPACITY)


def segment_assign(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("user_id", "ordinal", "segment_id", "offset")


def id_mapping(spark: SparkSession, d: str) -> DataFrame:
    return segments.id_mapping(_assigned(spark, d))


def id_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = _assigned(spark, d)
    beyond = a.select((-F.col("user_id") - 1).alias("user_id"))
    return segments.id_lookup(segments.id_mapping(a), a.select("user_id").unionAll(beyond))


def segment_topk(spark: SparkSession, d: str) -> DataFrame:
    a = _assigned(spark, d)
    return _rounded(segments.segment_topk(query_set(a), a, K))


def segmented_knn(spark: SparkSession, d: str) -> DataFrame:
    a = _assigned(spark, d)
    return _rounded(segments.segmented_knn(query_set(a), a, K))


def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_stats(_assigned(spark, d), CAPACITY)


def db_stats(spark: SparkSession, d: str) -> DataFrame:
    """As after a load: each stored segment is sealed and the empty active one counts."""
    a = _assigned(spark, d)
    dim = F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("bigint").alias("dimensions")
    return a.agg(F.count(F.lit(1)).alias("total_vectors"), (F.countDistinct("segment_id") + 1).alias("segment_count"), dim)


def insert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The table as a batch, with every row whose id is divisible by 3 twice, into a collection that holds ids divisible by 7."""
    v = vectors(spark, d)
    batch = v.unionAll(v.where(F.col("user_id") % 3 == 0))
    return segments.rejected(batch, v.where(F.col("user_id") % 7 == 0))


def sq8_params(spark: SparkSession, d: str) -> DataFrame:
    out = sq8.params_frame(vectors(spark, d))
    return out.select(F.col("dim").cast("bigint").alias("dim"), F.round("min", 6).alias("min"), F.round("scale", 6).alias("scale"))


def _codes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, sq8.Sq8Params]:
    v = vectors(spark, d)
    p = sq8.fit(v)
    return v, sq8.encode(v, p), p


def sq8_encode(spark: SparkSession, d: str) -> DataFrame:
    _, codes, _ = _codes(spark, d)
    out = codes.select("user_id", F.posexplode("code").alias("dim", "code"))
    return out.select("user_id", F.col("dim").cast("bigint").alias("dim"), F.col("code").cast("bigint").alias("code"))


def sq8_decode(spark: SparkSession, d: str) -> DataFrame:
    _, codes, p = _codes(spark, d)
    out = sq8.decode(codes, p).select("user_id", F.posexplode("embedding").alias("dim", "value"))
    return out.select("user_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def sq8_topk(spark: SparkSession, d: str) -> DataFrame:
    v, codes, p = _codes(spark, d)
    return _rounded(sq8.topk(query_set(v), codes, p, K))


def sq8_topk_arrow(spark: SparkSession, d: str) -> DataFrame:
    v, codes, p = _codes(spark, d)
    return _rounded(sq8.topk_arrow(query_set(v), codes, p, K))


def sq8_error(spark: SparkSession, d: str) -> DataFrame:
    """Largest and mean relative error of asymmetric distances, over pairs of distance above 0."""
    v, codes, p = _codes(spark, d)
    q = query_set(v)
    exact = flat.l2_pairs(q, v).withColumnRenamed("distance", "exact").where("exact > 0")
    both = exact.join(sq8.pairs(q, codes, p), ["query_id", "user_id"])
    error = F.abs(F.col("distance") - F.col("exact")) / F.col("exact")
    return both.agg(F.round(F.max(error), 6).alias("max_error"), F.round(F.avg(error), 6).alias("avg_error"), F.count(F.lit(1)).alias("pairs"))


def recall_sq8(spark: SparkSession, d: str) -> DataFrame:
    v, codes, p = _codes(spark, d)
    q = query_set(v)
    out = evaluate.recall(sq8.topk(q, codes, p, K), flat.knn_batch(q, v, K), K)
    return out.withColumn("recall", F.round("recall", 6))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    a = _assigned(spark, d)
    return a, staged(hnsw.build(a), "segments", **hnsw.WRITE), queries_of(query_set(a))


def hnsw_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """A beam as wide as the segment reaches all that layer 0 connects, so the result is the exact one."""
    _, nodes, q = _graph(spark, d)
    return _rounded(hnsw.search(q, nodes, K, hnsw.HnswSearchParams(ef_search=CAPACITY)))


def hnsw_topk(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, q = _graph(spark, d)
    return _rounded(hnsw.search(q, nodes, K))


def hnsw_invariants(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.invariants(_graph(spark, d)[1])


def hnsw_reachable(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.reachable(_graph(spark, d)[1])


def hnsw_levels(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.nodes(_graph(spark, d)[1]).groupBy("segment_id", F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("nodes"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    a, nodes, q = _graph(spark, d)
    out = evaluate.recall(hnsw.search(q, nodes, K), flat.knn_batch(query_set(a), a, K), K)
    return out.withColumn("recall", F.round("recall", 6))


NAMED = (l2_pairs, flat_topk, knn_batch, knn_arrow, segment_assign, id_mapping, id_lookup, segment_topk, segmented_knn, segment_stats, db_stats, insert_dedupe, sq8_params, sq8_encode, sq8_decode, sq8_topk, sq8_topk_arrow, sq8_error, recall_sq8, hnsw_exhaustive, hnsw_topk, hnsw_invariants, hnsw_reachable, hnsw_levels, recall_at_k)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}


_L2 = "coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE))), 0)"
_PAIRS = f"WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % {STRIDE} = 0), p AS (SELECT query_id, vec_id AS user_id, {_L2.format(a='q', b='embedding')} AS distance FROM q, embeddings)"
_KNN = f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, user_id) AS rank FROM p)"
_TOP = f"{_KNN} SELECT query_id, rank, user_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}"
_ORD = "a AS (SELECT vec_id AS user_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings)"
_SEG = f"{_ORD}, s AS (SELECT user_id, embedding, ordinal, ordinal // {CAPACITY} AS segment_id, ordinal % {CAPACITY} AS \"offset\" FROM a)"
# Offsets below CAPACITY whose node's top layer is 1 or 2, by the seeded sequence of layers; none is higher.
_LEVEL_1, _LEVEL_2 = "12, 20, 21, 35, 37, 43, 58, 65, 73, 84, 99", "27"
_CELLS = "c AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), w AS (SELECT dim, min(x) AS lo, max(x) - min(x) AS width FROM c GROUP BY dim), sp AS (SELECT dim, lo, CASE WHEN width < 1e-10 THEN 1.0::DOUBLE ELSE width END AS scale FROM w)"
_CODES = f"{_CELLS}, code AS (SELECT vec_id, dim, lo, scale, CAST(round(least(greatest((x - lo) / scale, 0), 1) * 255) AS BIGINT) AS code FROM c JOIN sp USING (dim))"
_DECODED = f"{_CODES}, dec AS (SELECT vec_id, list(code / 255.0::DOUBLE * scale + lo ORDER BY dim) AS v FROM code GROUP BY vec_id)"
_ASYM = f"{_DECODED}, ap AS (SELECT q.vec_id AS query_id, dec.vec_id AS user_id, {_L2.format(a='q.embedding', b='dec.v')} AS distance, {_L2.format(a='q.embedding', b='e.embedding')} AS exact FROM embeddings q, dec JOIN embeddings e ON e.vec_id = dec.vec_id WHERE q.vec_id % {STRIDE} = 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "l2_pairs": f"{_PAIRS} SELECT query_id, user_id, round(distance, 6) AS distance FROM p",
        "flat_topk": f"SELECT vec_id AS user_id, round({_L2.format(a='q', b='embedding')}, 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY {_L2.format(a='q', b='embedding')}, vec_id LIMIT {K}",
        "knn_batch": _TOP,
        "knn_arrow": _TOP,
        "segment_assign": f"WITH {_SEG} SELECT user_id, ordinal, segment_id, \"offset\" FROM s",
        "id_mapping": f"WITH {_SEG} SELECT segment_id, \"offset\", user_id FROM s",
        "id_lookup": f"WITH {_SEG}, t AS (SELECT user_id FROM s UNION ALL SELECT -user_id - 1 FROM s) SELECT t.user_id, segment_id, \"offset\" FROM t LEFT JOIN s ON s.user_id = t.user_id",
        "segment_topk": f"{_PAIRS}, {_SEG}, r AS (SELECT query_id, segment_id, user_id, distance, row_number() OVER (PARTITION BY query_id, segment_id ORDER BY distance, user_id) AS rank FROM p JOIN s USING (user_id)) SELECT query_id, segment_id, rank, user_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}",
        "segmented_knn": _TOP,
        "segment_stats": f"WITH {_SEG} SELECT segment_id, count(*) AS size, count(*) >= {CAPACITY} AS is_full FROM s GROUP BY segment_id",
        "db_stats": f"WITH {_SEG} SELECT count(*) AS total_vectors, count(DISTINCT segment_id) + 1 AS segment_count, coalesce(max(len(embedding)), 0)::BIGINT AS dimensions FROM s",
        "insert_dedupe": "SELECT vec_id AS user_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS times, vec_id % 7 = 0 AS stored FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0",
        "sq8_params": f"WITH {_CELLS} SELECT dim, round(lo, 6) AS \"min\", round(scale, 6) AS scale FROM sp",
        "sq8_encode": f"WITH {_CODES} SELECT vec_id AS user_id, dim, code FROM code",
        "sq8_decode": f"WITH {_CODES} SELECT vec_id AS user_id, dim, round(code / 255.0::DOUBLE * scale + lo, 6) AS value FROM code",
        "sq8_topk": f"WITH {_ASYM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, user_id) AS rank FROM ap) SELECT query_id, rank, user_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}",
        "sq8_topk_arrow": f"WITH {_ASYM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, user_id) AS rank FROM ap) SELECT query_id, rank, user_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}",
        "sq8_error": f"WITH {_ASYM} SELECT round(max(abs(distance - exact) / exact), 6) AS max_error, round(avg(abs(distance - exact) / exact), 6) AS avg_error, count(*) AS pairs FROM ap WHERE exact > 0",
        "recall_sq8": f"WITH {_ASYM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, user_id) AS near, row_number() OVER (PARTITION BY query_id ORDER BY exact, user_id) AS truth FROM ap) SELECT query_id, round(count(*) FILTER (WHERE near <= {K}) / count(*)::DOUBLE, 6) AS recall FROM r WHERE truth <= {K} GROUP BY query_id",
        "hnsw_exhaustive": _TOP,
        "hnsw_levels": f"WITH {_SEG}, l AS (SELECT segment_id, CASE WHEN \"offset\" IN ({_LEVEL_1}) THEN 1 WHEN \"offset\" IN ({_LEVEL_2}) THEN 2 ELSE 0 END::BIGINT AS level FROM s) SELECT segment_id, level, count(*) AS nodes FROM l GROUP BY ALL",
        "hnsw_reachable": f"WITH {_SEG} SELECT segment_id, count(*) AS nodes, count(*) AS reached FROM s GROUP BY segment_id",
        "hnsw_invariants": "SELECT 0::BIGINT AS one_way, 0::BIGINT AS over_degree, 0::BIGINT AS dangling",
    }
