"""Exact deduplication as a stateful stream.

Digests of the texts, with the row's stable identifier and its content locator (file and row), are staged and
then streamed through a keyed state on disk (RocksDB) that never expires: for each (digest, slot) it retains
the digest, the least identifier with its locator, and the number of rows. Spark combines equal digests before
the shuffle, so a text that a third of all rows share costs each task one row. A hit - a row whose digest has
another keeper - is then checked byte by byte against the content at the keeper's locator; rows that differ
move to the digest's next slot and pass through the state again. So collisions of digests cannot merge texts.

With a state folder, the state outlives the call: the next call with that folder compares its rows with those of all
calls before (whose files must still be there, with a text column), and a group counts them too.

Texts are equal when identical after each run of ASCII white space is one space; null is the empty text. Null
identifiers come after all others; rows of equal identifier and text are told apart by their locator. No rows give no
rows. Input columns named like a result are left out of exact_dedup's rows; kept_documents returns all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import PLACE, SPACE, documents, located, scratch, staged, text_of

#: Hits whose locators are sent to every task; more are joined by shuffle.
BROADCAST_HITS = 100_000
#: Hits that are compared with one copy of their keeper's text.
HITS_PER_COPY = 256
#: Files of digests in one micro-batch.
FILES_PER_BATCH = 64
KEYS = ["digest", "slot"]
RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised() -> Column:
    return F.regexp_replace(text_of(), SPACE, " ")


def keepers(spark: SparkSession, rows: DataFrame, files_per_batch: int, root: str) -> DataFrame:
    """(digest, slot, keeper, n) of all digests that the state below root has seen, by the stateful stream; the rows are added to it."""
    source, out = f"{root}/digests", f"{root}/keepers"
    rows.write.mode("append").parquet(source)
    session = spark.newSession()  # its settings are no other query's
    for k, v in STATE.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", *PLACE)).alias("keeper")
    state = stream.groupBy(*KEYS).agg(least, F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/at={number}")

    state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    place = "struct<late:boolean,doc_id:bigint,_nf_file:string,_nf_row:bigint>"
    found = spark.read.schema(f"digest binary, slot int, keeper {place}, n bigint, batch int").parquet(out) if rows.limit(1).count() else None
    if found is None:
        return spark.createDataFrame([], f"digest binary, slot int, keeper {place}, n bigint")
    newest = found.groupBy(*KEYS).agg(F.max_by(F.struct("keeper", "n"), "batch").alias("x"))
    return newest.select(*KEYS, "x.keeper", "x.n")


def exact_dedup(docs: DataFrame, *, digest: Column | None = None, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """One row for each row of docs: its columns but text, and keep_id, group_size, kept, text_sha256, and the locator.

    digest: an expression over `sha` for tests of collisions. state: a shared folder for a state that outlives the call.
    """
    spark = docs.sparkSession
    here = located(docs)
    root = state or scratch(spark, "dedup-state")
    others = [c for c in docs.columns if c not in ("text", *PLACE, *RESULTS)]
    sha = F.sha2(normalised().cast("binary"), 256)
    rows = here.select(F.struct(F.lit(0).alias("_nf_none"), *others).alias("kept_columns"), F.col("doc_id").cast("bigint").alias("doc_id"), *PLACE, F.unhex(sha).alias("sha"))
    rows = rows.withColumn("digest", F.col("sha") if digest is None else digest).withColumn("slot", F.lit(0))
    rows = staged(rows, "digests")
    settled, level = [], 0
    while True:
        found = keepers(spark, rows.drop("kept_columns", "sha"), files_per_batch, f"{root}/{level}")
        if state:  # of all that the state holds, what these rows ask for
            found = found.join(rows.select(*KEYS).distinct(), KEYS, "left_semi")
        found = staged(found, "keepers")
        joined = rows.join(found, KEYS)
        others_match = staged(mismatches(here, joined, found), "mismatches")
        if others_match.limit(1).count() == 0:
            settled.append(joined)
            break
        if state:
            raise ValueError("two texts share a digest; a state that outlives a call keeps one text for each")
        same = staged(joined.join(others_match.select(*PLACE), PLACE, "left_anti"), "settled").drop("n")
        settled.append(same.join(same.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS))
        rows = staged(rows.join(others_match.select(*PLACE), PLACE, "left_semi").withColumn("slot", F.col("slot") + 1).select(*rows.columns), "digests")
        level += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    here_is = (F.col("keeper._nf_file") == F.col("_nf_file")) & (F.col("keeper._nf_row") == F.col("_nf_row"))
    return out.select("kept_columns.*", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), here_is.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *PLACE).drop("_nf_none")


def mismatches(here: DataFrame, joined: DataFrame, found: DataFrame) -> DataFrame:
    """Locators of the hits whose normalised bytes are not those of their keeper.

    A keeper's text is copied once for every HITS_PER_COPY rows of its group, so no task gets all of a large group.
    """
    copies = F.expr(f"(n - 1) div {HITS_PER_COPY}")
    hits = joined.where((F.col("keeper._nf_file") != F.col("_nf_file")) | (F.col("keeper._nf_row") != F.col("_nf_row")))
    hits = staged(hits.select(*PLACE, *KEYS, F.pmod(F.xxhash64(*PLACE), copies + 1).alias("copy")), "hits")
    many = found.where("n > 1").select(F.col("keeper._nf_file").alias("_nf_file"), F.col("keeper._nf_row").alias("_nf_row"), *KEYS, "n")
    small = hits.count() <= BROADCAST_HITS  # groups have more hits than keepers
    texts = here.select(*PLACE, normalised().alias("bytes"))
    near = F.broadcast if small else (lambda x: x)
    # Keepers of earlier calls lie in files that are not of this one.
    files = [r[0] for r in many.select("_nf_file").distinct().join(here.select("_nf_file").distinct(), "_nf_file", "left_anti").collect()]
    known = texts.unionAll(located(here.sparkSession.read.parquet(*files).select("text")).select(*PLACE, normalised().alias("bytes"))) if files else texts
    theirs = known.join(near(many), PLACE).select(*KEYS, F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias("copy"), F.col("bytes").alias("kept_bytes"))
    mine = texts.join(near(hits), PLACE)
    return mine.join(theirs, [*KEYS, "copy"]).where("bytes <> kept_bytes").select(*PLACE)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    here = located(docs)
    found = exact_dedup(here.select("doc_id", "text", *PLACE))
    lost = found.where(~F.col("kept")).select(*PLACE)
    small = lost.count() <= BROADCAST_HITS
    return here.join(F.broadcast(lost) if small else lost, PLACE, "left_anti").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop(*PLACE)


SQL = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""
