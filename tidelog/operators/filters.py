"""Predicates of queries and validation of requests."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import bloom, scalar
from tidelog.sources.schemas import ACTIVE, BAKED, FRESH, READY, SEALED

INVALID_ARGUMENT, OK = "INVALID_ARGUMENT", "OK"


@dataclass(frozen=True)
class LogQuery:
    """A semantic query. The caller is required but never filters; an empty id filter is a filter, and matches nothing."""

    caller_agent_id: str
    query: str
    session_id: str | None = None
    agent_id: str | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None

    def check(self) -> None:
        for name in ("caller_agent_id", "query"):
            if not getattr(self, name):
                raise ValueError(f"{INVALID_ARGUMENT}: {name} is empty")


def all_of(predicates: list[Column]) -> Column:
    """Their conjunction; true without any."""
    return reduce(and_, predicates, F.lit(True))


def record_filter(q, agent: str = "agent_id", session: str = "session_id", ts: str = "ts") -> Column:
    """The present filters of a query, all of them: ids equal byte by byte, times inclusive at both ends."""
    found = []
    if q.agent_id is not None:
        found.append(F.col(agent) == F.lit(q.agent_id))
    if q.session_id is not None:
        found.append(F.col(session) == F.lit(q.session_id))
    if q.start_time is not None:
        found.append(F.col(ts) >= F.lit(q.start_time))
    if q.end_time is not None:
        found.append(F.col(ts) <= F.lit(q.end_time))
    return all_of(found)


def has_embedding(embedding: str = "embedding") -> Column:
    return F.size(embedding) > 0


def similar(score: Column, threshold: float) -> Column:
    """At or above the threshold; NaN, which sorts above all numbers, is not."""
    return (score >= F.lit(float(threshold))) & ~F.isnan(score)


def overlaps(q) -> Column:
    """Blocks whose [min_ts, max_ts] meets the query's times; a bound that is absent excludes nothing."""
    found = []
    if q.end_time is not None:
        found.append(F.col("min_ts") <= F.lit(q.end_time))
    if q.start_time is not None:
        found.append(F.col("max_ts") >= F.lit(q.start_time))
    return all_of(found)


def candidate_blocks(blocks: DataFrame, q, bits: int, hashes: int) -> DataFrame:
    """The blocks that may hold matches.

    Baked blocks are judged by time and blooms, sealed fresh ones by time; the active one always counts, as its
    statistics still move.
    """
    held = []
    if q.agent_id is not None:
        held.append(bloom.may_contain(F.col("agent_bloom"), q.agent_id, bits, hashes))
    if q.session_id is not None:
        held.append(bloom.may_contain(F.col("session_bloom"), q.session_id, bits, hashes))
    baked = (F.col("block_type") == BAKED) & (F.col("state") == READY) & overlaps(q) & all_of(held)
    sealed = (F.col("block_type") == FRESH) & (F.col("state") == SEALED) & overlaps(q)
    active = (F.col("block_type") == FRESH) & (F.col("state") == ACTIVE)
    return blocks.where(baked | sealed | active)


def validated(rows: DataFrame) -> DataFrame:
    """Store requests with status and error_message: ids and log must not be missing."""
    required = ("agent_id", "session_id", "conversation_log")
    missing = F.array_compact(F.array(*[F.when(scalar.is_blank(F.col(c)), F.lit(c)) for c in required]))
    named = F.array_join(missing, ", ")
    return rows.withColumn("status", F.when(F.size(missing) > 0, INVALID_ARGUMENT).otherwise(OK)).withColumn(
        "error_message", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), named)).otherwise("")
    )
