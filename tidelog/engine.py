"""The log store: append, ingest, compact, trim, query, status."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import LogConfig
from tidelog.functions import bloom
from tidelog.functions.embed import Embedder
from tidelog.operators import blocks as op
from tidelog.operators.filters import INVALID_ARGUMENT, OK, LogQuery, candidate_blocks, record_filter, validated
from tidelog.operators.scoring import matching_many
from tidelog.plans import status
from tidelog.plans.query import COMPLETE, INTERNAL_ERROR, QueryResult, plan, run_with_deadline
from tidelog.sources import files
from tidelog.sources.blocks import BlockStore
from tidelog.sources.manifest import Conflict, Manifest, latest_active
from tidelog.sources.schemas import ACTIVE, BAKED, BLOCKS, COMPACTED, FRESH, READY, RESULT, SEALED, STORE
from tidelog.sources.wal import WalTable


def _now() -> int:
    return time.time_ns() // 1000


class LogStore:
    """A store in a folder; one writer at a time, any number of readers, each with one snapshot for a query."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, config: LogConfig = LogConfig()):
        self.spark, self.root, self.embedder, self.config = spark, root.rstrip("/"), embedder, config
        self.manifest = Manifest(spark, f"{self.root}/manifest")
        self.wal = WalTable(spark, self.root, self.manifest)
        self.blocks = BlockStore(spark, self.root)
        self.bloom_size = bloom.size_for(config.max_records_per_block, config.bloom_false_positives)

    # ---- store

    def store(self, rows: DataFrame) -> DataFrame:
        """Append the valid rows; returns the invalid ones with status and error_message."""
        checked = validated(rows.select(*[F.col(f.name).cast(f.dataType) for f in STORE.fields]))
        self.wal.append(checked.where(F.col("status") == OK))
        return checked.where(F.col("status") != OK)

    def store_one(self, agent_id: str, session_id: str, conversation_log: str, ts: datetime | None = None, summary: str | None = None) -> tuple[str, str]:
        """(status, error_message) of one request."""
        row = self.spark.createDataFrame([(agent_id, session_id, conversation_log, ts, summary)], STORE)
        bad = self.store(row).select("status", "error_message").collect()
        return (bad[0][0], bad[0][1]) if bad else (OK, "")

    # ---- ingest

    def ingest(self, limit: int | None = None) -> int:
        """Move one batch of unprocessed records into fresh blocks; returns how many.

        The batch's folder, its blocks and the cursor are committed at once, so that after any failure, or another
        writer's commit, it is as if the batch had not begun.
        """
        at = self.manifest.cursors()
        size, first = self.config.max_records_per_block, at.last_processed_seq + 1
        rows = self.wal.read(at.last_processed_seq, limit or self.config.wal_read_batch, at)
        upto = min(at.next_seq - 1, at.last_processed_seq + (limit or self.config.wal_read_batch))
        if upto < first:
            return 0
        now = _now()
        active = latest_active(self.manifest.blocks(at)).collect()
        carried = active[0]["record_count"] if active else 0
        # the active block is filled first; later ones get new ids, which lie beyond those of blocks baked since
        first_block = active[0]["block_id"] if active else at.next_block_id
        new_blocks = at.next_block_id - (1 if active else 0)
        offset = op.block_offset(F.col("wal_seq"), at.last_processed_seq, carried, size)
        block_id = F.when(offset == 0, F.lit(first_block)).otherwise(F.lit(new_blocks) + offset)
        batch = self.blocks.write_fresh(op.to_records(rows, self.embedder, block_id), first)
        after = at.fresh_batches + (batch,)
        written = self.blocks.read_fresh(type(at)(fresh_batches=(batch,)))
        stats = op.block_stats(written)
        if active:
            held = self.spark.createDataFrame([(first_block, carried, active[0]["min_ts"], active[0]["max_ts"])], stats.schema)
            stats = stats.unionByName(held).groupBy("block_id").agg(F.sum("record_count").alias("record_count"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
        changed = stats.select(
            "block_id",
            F.lit(f"{self.root}/fresh").alias("block_path"),
            F.lit(FRESH).alias("block_type"),
            F.when(F.col("record_count") >= size, SEALED).otherwise(ACTIVE).alias("state"),
            "record_count",
            "min_ts",
            "max_ts",
            F.lit(None).cast("binary").alias("agent_bloom"),
            F.lit(None).cast("binary").alias("session_bloom"),
            F.lit(None).cast("long").alias("parent_block_id"),
            F.timestamp_micros(F.lit(now)).alias("created_at"),
        )
        n = upto - first + 1
        next_block = max(at.next_block_id, new_blocks + (carried + n - 1) // size + 1)
        try:
            self.manifest.commit(at, changed, last_processed_seq=upto, next_block_id=next_block, fresh_batches=after, last_ingestion_run=now)
        except Conflict:
            self.blocks.delete_fresh(batch)
            raise
        self.trim_wal()
        return n

    def ingest_all(self) -> int:
        total = 0
        while n := self.ingest():
            total += n
        return total

    def trim_wal(self) -> int:
        at = self.manifest.cursors()
        upto = op.keep_last(at.next_seq, at.trimmed_to, at.last_processed_seq, self.config.max_records_per_block, self.config.wal_trim_threshold)
        return self.wal.trim(upto)

    # ---- compact

    def compact(self, most: int = 10_000) -> int:
        """Bake all sealed blocks, one baked block for each, at most `most` with one commit; returns how many."""
        total = 0
        while n := self._compact_some(most):
            total += n
        return total

    def _compact_some(self, most: int) -> int:
        """One commit's share of compact().

        The manifest is the queue: what a stopped run left sealed is baked by the next. Readers of an older
        snapshot keep their fresh files until vacuum().
        """
        at = self.manifest.cursors()
        every = self.manifest.blocks(at)
        sealed = [r[0] for r in every.where((F.col("block_type") == FRESH) & (F.col("state") == SEALED)).orderBy("block_id").limit(most).select("block_id").collect()]
        if not sealed:
            return 0
        now, run = _now(), at.version + 1
        ids = self.spark.createDataFrame([(old, at.next_block_id + i) for i, old in enumerate(sealed)], "old long, new long")
        records = self.blocks.read_fresh(at).where(F.col("block_id").isin(sealed)) if len(sealed) <= 1000 else self.blocks.read_fresh(at)
        moved = records.join(F.broadcast(ids), F.col("block_id") == F.col("old")).withColumn("block_id", F.col("new")).drop("old", "new")
        path = self.blocks.write_baked(moved, run)
        baked = self.blocks.read_baked([path])
        stats = op.block_stats(baked).join(op.block_blooms(baked, *self.bloom_size), "block_id").join(F.broadcast(ids), F.col("block_id") == F.col("new"))
        made = stats.select(
            "block_id",
            F.lit(path).alias("block_path"),
            F.lit(BAKED).alias("block_type"),
            F.lit(READY).alias("state"),
            "record_count",
            "min_ts",
            "max_ts",
            "agent_bloom",
            "session_bloom",
            F.col("old").alias("parent_block_id"),
            F.timestamp_micros(F.lit(now)).alias("created_at"),
        )
        parents = every.join(F.broadcast(ids), F.col("block_id") == F.col("old"), "left_semi").withColumn("state", F.lit(COMPACTED))
        try:
            self.manifest.commit(
                at, made.unionByName(parents.select(*BLOCKS.names)), next_block_id=at.next_block_id + len(sealed), last_compaction_run=now
            )
        except Conflict:
            files.delete(self.spark, path)
            raise
        return len(sealed)

    def vacuum(self) -> int:
        """Delete fresh batches all of whose blocks are baked; only when no reader of an older snapshot is left."""
        at = self.manifest.cursors()
        alive = {r[0] for r in self.manifest.blocks(at).where((F.col("block_type") == FRESH) & F.col("state").isin(ACTIVE, SEALED)).select("block_id").collect()}
        gone = []
        for batch in at.fresh_batches:
            ids = {int(n.split("=")[1]) for n in files.names(self.spark, self.blocks.fresh_path(batch)) if n.startswith("block_id=")}
            if not ids & alive:
                gone.append(batch)
        if gone:
            self.manifest.commit(at, fresh_batches=tuple(b for b in at.fresh_batches if b not in gone))
            for batch in gone:
                self.blocks.delete_fresh(batch)
        return len(gone)

    # ---- query

    def query(self, q: LogQuery, deadline: bool = False) -> QueryResult:
        """The records that match, unordered; lazy unless a deadline is asked for.

        An invalid query raises ValueError; an embedder's failure is an INTERNAL_ERROR.
        """
        q.check()
        at = self.manifest.cursors()
        try:
            vector = self.embedder.vector(self.spark, q.query)
        except Exception as error:  # noqa: BLE001 - any failure of a model
            return QueryResult(INTERNAL_ERROR, self.spark.createDataFrame([], RESULT), f"embedding failed: {error}")
        if deadline:
            return run_with_deadline(self, q, vector, at)
        return QueryResult(COMPLETE, plan(self, q, vector, at))

    def query_many(self, queries: dict[str, str], filters: LogQuery | None = None) -> DataFrame:
        """Many texts in one scan, with common filters: query_id and the four result columns."""
        at = self.manifest.cursors()
        q = filters or LogQuery("batch", "batch")
        texts = self.spark.createDataFrame(list(queries.items()), "query_id string, text string")
        vectors = [(r[0], list(r[1])) for r in texts.select("query_id", self.embedder.column(F.col("text"))).collect()]
        records = self.blocks.read(candidate_blocks(self.manifest.blocks(at), q, *self.bloom_size), at).where(record_filter(q))
        hits = matching_many(records, vectors, self.config.similarity_threshold)
        return hits.select("query_id", "agent_id", "session_id", F.col("ts").alias("timestamp"), "raw_conversation_log")

    # ---- status

    def status(self) -> DataFrame:
        return status.snapshot(self.manifest)

    def status_page(self) -> str:
        return status.render(self.status().first(), status.baked_blocks(self.manifest.blocks()).collect())


__all__ = ["INVALID_ARGUMENT", "OK", "LogConfig", "LogQuery", "LogStore"]
