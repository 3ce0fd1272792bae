"""Streaming ingestion into a collection (an extension): each micro-batch is one atomic insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.database import Database


def ingest(stream: DataFrame, database: Database, checkpoint: str) -> StreamingQuery:
    """Starts a query that inserts (user_id, embedding) batch by batch until the stream's current end.

    A batch that is delivered again after a failure holds ids that are stored already; those rows are left out.
    """

    def insert(batch: DataFrame, _: int) -> None:
        database.insert(batch.join(database.vectors().select("user_id"), "user_id", "left_anti"))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
