"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own, but only if all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, at: str, **options) -> DataFrame:
    """The rows, written once to a folder and read from there."""
    rows.write.options(**options).parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def staged(rows: DataFrame, name: str, **options) -> DataFrame:
    """The same in the shared folder: lineage ends here, and all passes see the same rows."""
    return stored(rows, scratch(rows.sparkSession, name), **options)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(rows: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    spark = rows.sparkSession
    root = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        if root in folder:
            remove(spark, folder)
