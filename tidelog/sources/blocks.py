"""Record blocks on disk: fresh ones as they arrive, baked ones sorted and compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.blocks import baked_order
from tidelog.sources import files
from tidelog.sources.manifest import Cursors
from tidelog.sources.schemas import BAKED, RECORDS

#: Candidate blocks whose ids are written into the scan; more are joined.
MOST_LITERALS = 1000
INDEX = ("block_id", "wal_seq", "agent_id", "session_id", "ts", "embedding")


class BlockStore:
    """Folders fresh/batch=<first number>-<tag>/block_id=<id> and baked/run=<version>-<tag>/block_id=<id>.

    Block and batch are partition columns, so a query's list of candidates prunes folders, and times and ids
    prune row groups.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def fresh_path(self, batch: str) -> str:
        return f"{self.root}/fresh/{batch}"

    def write_fresh(self, records: DataFrame, first: int) -> str:
        """One ingest batch, in a folder of its own; returns the folder's name, which counts once it is committed."""
        batch = f"batch={first:018d}-{files.tag()}"
        records.write.option("compression", "zstd").partitionBy("block_id").parquet(self.fresh_path(batch))
        return batch

    def read_fresh(self, at: Cursors) -> DataFrame:
        paths = [self.fresh_path(b) for b in at.fresh_batches]
        if not paths:
            return self.spark.createDataFrame([], RECORDS)
        parts = [self.spark.read.schema(RECORDS).option("basePath", p).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*RECORDS.names)

    def write_baked(self, records: DataFrame, run: int) -> str:
        """Whole blocks, each sorted by time, agent, session and number."""
        path = f"{self.root}/baked/run={run:012d}-{files.tag()}"
        baked_order(records).write.option("compression", "zstd").partitionBy("block_id").parquet(path)
        return path

    def read_baked(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RECORDS)
        parts = [self.spark.read.schema(RECORDS).option("basePath", p).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*RECORDS.names)

    def read(self, candidates: DataFrame, at: Cursors) -> DataFrame:
        """The records of the candidate blocks, baked and fresh.

        A few candidates become literals, which prune folders when the query is planned; many are joined by block,
        where folders are pruned at run time.
        """
        few = candidates.select("block_id", "block_type", "block_path").limit(MOST_LITERALS + 1).collect()
        if not few:
            return self.spark.createDataFrame([], RECORDS)
        if len(few) <= MOST_LITERALS:
            baked = sorted({r["block_path"] for r in few if r["block_type"] == BAKED})
            ids = lambda kind: [r["block_id"] for r in few if (r["block_type"] == BAKED) == kind]
            out = self.read_baked(baked).where(F.col("block_id").isin(ids(True)))
            return out.unionByName(self.read_fresh(at).where(F.col("block_id").isin(ids(False))))
        paths = [r[0] for r in candidates.where(F.col("block_type") == BAKED).select("block_path").distinct().collect()]
        every = self.read_baked(sorted(paths)).unionByName(self.read_fresh(at))
        return every.join(candidates.select("block_id"), "block_id", "left_semi")

    def index(self, records: DataFrame) -> DataFrame:
        """Keys and embeddings without the logs: a narrower scan of the same files."""
        return records.select(*INDEX)

    def payloads(self, hits: DataFrame, records: DataFrame) -> DataFrame:
        """hits (block_id, wal_seq, ...) with their logs, by a second scan of the records."""
        return hits.join(records.select("block_id", "wal_seq", "raw_conversation_log"), ["block_id", "wal_seq"])

    def delete_fresh(self, batch: str) -> bool:
        return files.delete(self.spark, self.fresh_path(batch))
