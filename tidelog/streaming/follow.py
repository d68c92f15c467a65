"""The log followed by Structured Streaming: every micro-batch is one commit of the state store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.plans.apply import apply_batch
from tidelog.sources.state import StateStore


def follow(spark: SparkSession, log_path: str, schema: str, store: StateStore, key: str, columns: list[str], checkpoint: str, files_per_batch: int = 8, once: bool = True, failpoint=lambda name: None) -> StreamingQuery:
    """Follow a folder of Parquet log segments, each holding whole transactions. foreachBatch is at least once; the ledger makes it exactly once."""
    epoch = store.acquire()

    def one(batch, _):
        apply_batch(store, epoch, batch, key, columns, failpoint)

    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    writer = log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
