"""A stream of store requests into a log store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import files
from tidelog.sources.schemas import STORE


def store_batch(store, rows: DataFrame, batch_id: int, stream: str) -> None:
    """One micro-batch: append and ingest it, once even if Spark repeats it.

    The marker of a batch is written after its append. A repeat that finds the marker only ingests; one whose append was
    committed but not marked is told apart by the number that the append started at.
    """
    marks = f"{store.root}/streams/{stream}"
    files.make_folder(store.spark, marks)
    begun, done = f"{marks}/{batch_id:012d}.begun", f"{marks}/{batch_id:012d}.done"
    if not files.exists(store.spark, done):
        files.write_new(store.spark, begun, str(store.manifest.cursors().next_seq))
        if int(files.read_text(store.spark, begun)) == store.manifest.cursors().next_seq:
            store.store(rows)
        files.write_new(store.spark, done, "")
    store.ingest_all()


def ingest_stream(store, requests: DataFrame, checkpoint: str, stream: str = "default", available_now: bool = True):
    """Start a query that stores and ingests a streaming DataFrame of requests; late and out-of-order times are accepted."""
    writer = requests.writeStream.foreachBatch(lambda rows, i: store_batch(store, rows, i, stream)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{store.config.poll_seconds} seconds")).start()


def folder_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Store requests from Parquet files as they appear in a folder."""
    return spark.readStream.schema(STORE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def synthetic_stream(spark: SparkSession, rows_per_second: int = 100, agents: int = 10, sessions: int = 50) -> DataFrame:
    """Made-up requests at a steady rate, for load tests."""
    n = F.col("value")
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(
        F.concat(F.lit("agent_"), n % agents).alias("agent_id"),
        F.concat(F.lit("session_"), n % sessions).alias("session_id"),
        F.concat(F.lit("synthetic conversation "), n).alias("conversation_log"),
        F.col("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("summary"),
    )
