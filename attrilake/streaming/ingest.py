"""Continuous ingest of inserts and deletes into a Parquet store.

Messages are (seq, op, object_id, key, value) with op 'insert' or 'delete'. The store is a log of
the last message of each triple in each batch; ``current`` resolves it. A batch that runs again
after a failure overwrites its own folder, so every message counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRIPLE = ["object_id", "key", "value"]
SCHEMA = "seq long, op string, object_id long, key string, value string"


def last_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*TRIPLE).agg(F.max(F.struct("seq", "op")).alias("m")).select(*TRIPLE, "m.seq", "m.op")


def ingest(messages: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing a stream of messages to ``store``."""

    def write(batch: DataFrame, number: int) -> None:
        last_messages(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The triples whose last message is an insert."""
    log = spark.read.schema(f"object_id long, key string, value string, seq long, op string, batch int").parquet(store)
    return last_messages(log).filter("op = 'insert'").select(*TRIPLE)


def compact(spark: SparkSession, store: str) -> None:
    """Resolve what the store holds into its newest batch's place, so that reading costs what is current.

    Run it while neither an ingest nor a reader runs; if it is cut off, ``_compacted`` holds all. Deletes stay as messages, as an older batch that is written again
    must not bring a triple back.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(store)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("batch=")]
    newest = max(batches, key=lambda p: int(p.getName().partition("=")[2]))
    log = spark.read.schema(f"{SCHEMA}, batch int").parquet(store).drop("batch")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{store}/_compacted")
    last_messages(log).write.mode("overwrite").parquet(fresh.toString())
    for p in batches:
        if p.getName() != newest.getName():
            files.delete(p, True)
    files.delete(newest, True)
    files.rename(fresh, newest)
