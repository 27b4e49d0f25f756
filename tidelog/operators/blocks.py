"""Assignment of records to blocks, block statistics and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.functions import bloom
from tidelog.functions.scalar import embedding_text
from tidelog.operators.filters import validated

BAKED_ORDER = ("ts", "agent_id", "session_id", "wal_seq")


def block_offset(wal_seq: Column, after: int, carried: int, size: int) -> Column:
    """How many blocks beyond the first a record lands.

    Sequence numbers have no gaps, so the arrival rank is a subtraction and needs no global sort: a block is
    full exactly at `size`, and the first one already holds `carried`.
    """
    return F.floor((wal_seq - F.lit(after) - 1 + F.lit(carried)) / F.lit(size)).cast("long")


def to_records(wal: DataFrame, embedder, block_id: Column) -> DataFrame:
    """Write-ahead rows as records: renamed, with the embedding of the summary or else the log; the summary goes."""
    return wal.select(
        block_id.alias("block_id"),
        "wal_seq",
        "agent_id",
        "session_id",
        "ts",
        F.col("conversation_log").alias("raw_conversation_log"),
        embedder.column(embedding_text(F.col("summary"), F.col("conversation_log"))).alias("embedding"),
    )


def block_stats(records: DataFrame) -> DataFrame:
    """block_id, record_count, min_ts, max_ts."""
    return records.groupBy("block_id").agg(F.count(F.lit(1)).alias("record_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def block_blooms(records: DataFrame, bits: int, hashes: int) -> DataFrame:
    """block_id, agent_bloom, session_bloom."""
    agents = bloom.build(records, "block_id", "agent_id", bits, hashes, "agent_bloom")
    return agents.join(bloom.build(records, "block_id", "session_id", bits, hashes, "session_bloom"), "block_id")


def baked_order(records: DataFrame) -> DataFrame:
    """Each block whole in one partition, sorted as baked blocks are."""
    return records.repartition("block_id").sortWithinPartitions("block_id", *BAKED_ORDER)


def keep_last(next_seq: int, trimmed_to: int, processed: int, size: int, threshold: int = 0) -> int:
    """The sequence number up to which the write-ahead table may go.

    Once it holds more than the threshold (0: twice the block size), all but the last `size` records go, but
    never one that is not processed yet.
    """
    if next_seq - 1 - trimmed_to <= (threshold or 2 * size):
        return trimmed_to
    return max(trimmed_to, min(next_seq - 1 - size, processed))


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) store requests."""
    checked = validated(rows)
    return checked.where("status = 'OK'").drop("status", "error_message"), checked.where("status <> 'OK'")


def lower_rank_percentiles(rows: DataFrame, group: str, value: str, ranks: dict[str, float]) -> DataFrame:
    """group and, for each name in ranks, the value at place floor((n - 1) * p) of its sorted values.

    Equal values are counted first, and a running count over the sorted distinct ones finds the places; nothing is
    gathered in memory. Nulls don't count; a group without values is left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    ranked = counts.withColumn("__upto", F.sum("__n").over(whole.orderBy(value))).withColumn("__all", F.sum("__n").over(whole))
    at = lambda p: F.min(F.when(F.col("__upto") > F.floor((F.col("__all") - 1) * F.lit(p)), F.col(value)))
    return ranked.groupBy(group).agg(*[at(p).alias(name) for name, p in ranks.items()])
