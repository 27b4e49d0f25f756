"""Queries over a snapshot: prune blocks, scan, filter, score, project; and the status of their results."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.filters import LogQuery, candidate_blocks, record_filter
from tidelog.operators.scoring import matching
from tidelog.sources.manifest import Cursors

COMPLETE, INCOMPLETE, INTERNAL_ERROR = "COMPLETE", "INCOMPLETE", "INTERNAL_ERROR"


@dataclass(frozen=True)
class QueryResult:
    status: str
    df: DataFrame
    error: str = ""


def result_status(scheduled: int, failed: int, pending: int, elapsed_ms: float, worker_timeout_ms: float, rows: int) -> str:
    """Incomplete if work is pending or it took too long; an error only if every group failed and nothing was found."""
    if pending > 0 or elapsed_ms > worker_timeout_ms:
        return INCOMPLETE
    if scheduled > 0 and failed == scheduled and rows == 0:
        return INTERNAL_ERROR
    return COMPLETE


def projected(records: DataFrame) -> DataFrame:
    """The four columns of a result."""
    return records.select("agent_id", "session_id", F.col("ts").alias("timestamp"), "raw_conversation_log")


def plan(store, q: LogQuery, vector: list[float], at: Cursors) -> DataFrame:
    """The query as one lazy DataFrame. Id and time filters come before the score, so they reach the scan."""
    config = store.config
    candidates = candidate_blocks(store.manifest.blocks(at), q, *store.bloom_size)
    records = store.blocks.read(candidates, at).where(record_filter(q))
    return projected(matching(records, vector, config.similarity_threshold, config.strict_dimensions))


def run_with_deadline(store, q: LogQuery, vector: list[float], at: Cursors) -> QueryResult:
    """Blocks dealt to groups, each a cancellable job that writes its rows; what has finished in time is the result."""
    spark, config = store.spark, store.config
    candidates = candidate_blocks(store.manifest.blocks(at), q, *store.bloom_size)
    folder, tag = f"{store.root}/results/{uuid.uuid4().hex}", f"query-{uuid.uuid4().hex}"
    groups = config.query_groups
    done: dict[int, str] = {}
    failed: dict[int, str] = {}

    def work(i: int) -> None:
        spark.addTag(tag)
        try:
            mine = candidates.where(F.pmod("block_id", F.lit(groups)) == i)
            rows = store.blocks.read(mine, at).where(record_filter(q))
            projected(matching(rows, vector, config.similarity_threshold, config.strict_dimensions)).write.parquet(f"{folder}/{i}")
            done[i] = f"{folder}/{i}"
        except Exception as error:  # noqa: BLE001 - a failed group is part of the status
            failed[i] = str(error).splitlines()[0] if str(error) else type(error).__name__
        finally:
            spark.removeTag(tag)

    began = time.monotonic()
    threads = [threading.Thread(target=work, args=(i,), daemon=True) for i in range(groups)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(max(0.0, began + config.query_timeout_ms / 1000 - time.monotonic()))
    pending = sum(t.is_alive() for t in threads)
    elapsed = (time.monotonic() - began) * 1000
    if pending:
        spark.interruptTag(tag)
    from tidelog.sources.schemas import RESULT

    finished = sorted(done.values())
    df = spark.read.schema(RESULT).parquet(*finished) if finished else spark.createDataFrame([], RESULT)
    rows = len(df.limit(1).collect())
    status = result_status(groups, len(failed), pending, elapsed, config.worker_timeout_ms, rows)
    return QueryResult(status, df, "; ".join(sorted(set(failed.values()))))
