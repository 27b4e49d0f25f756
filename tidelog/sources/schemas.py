"""Schemas of all tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    """Fields by name; a type in a list is required."""
    return StructType([StructField(n, t[0] if isinstance(t, list) else t, not isinstance(t, list)) for n, t in fields.items()])


LONG, STRING, TIME, BINARY = LongType(), StringType(), TimestampType(), BinaryType()
STORE = _struct(agent_id=STRING, session_id=STRING, conversation_log=STRING, ts=TIME, summary=STRING)
WAL = _struct(wal_seq=[LONG], agent_id=[STRING], session_id=[STRING], ts=[TIME], conversation_log=[STRING], summary=STRING)
RECORDS = _struct(
    block_id=[LONG], wal_seq=[LONG], agent_id=[STRING], session_id=[STRING], ts=[TIME], raw_conversation_log=[STRING], embedding=[ArrayType(FloatType(), False)]
)
BLOCKS = _struct(
    block_id=[LONG], block_path=[STRING], block_type=[STRING], state=[STRING], record_count=[LONG], min_ts=TIME, max_ts=TIME,
    agent_bloom=BINARY, session_bloom=BINARY, parent_block_id=LONG, created_at=[TIME],
)
RESULT = _struct(agent_id=STRING, session_id=STRING, timestamp=TIME, raw_conversation_log=STRING)
FRESH, BAKED = "FRESH", "BAKED"
ACTIVE, SEALED, COMPACTED, READY = "ACTIVE", "SEALED", "COMPACTED", "READY"
