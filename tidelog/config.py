"""Settings of a log store."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LogConfig:
    """Block size, write-ahead retention (0: twice the block size), ingest batch, threshold and deadlines.

    The deadlines are longer than a single-node server's, as a Spark job alone takes tens of milliseconds.
    """

    max_records_per_block: int = 2000
    wal_trim_threshold: int = 0
    wal_read_batch: int = 200_000
    similarity_threshold: float = 0.2
    query_timeout_ms: int = 60_000
    worker_timeout_ms: int = 60_000
    query_groups: int = 8
    strict_dimensions: bool = True
    bloom_false_positives: float = 0.01
    poll_seconds: float = 0.1
