"""The write-ahead table: appended in batches, numbered without gaps, read by number, trimmed from the front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.functions.scalar import is_blank, or_now
from tidelog.sources import files
from tidelog.sources.manifest import Conflict, Cursors, Manifest
from tidelog.sources.schemas import WAL


class WalTable:
    """Batches are folders wal/first=<sequence number of their first record>-<tag>; the manifest lists those in force."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest):
        self.spark, self.root, self.manifest = spark, f"{root.rstrip('/')}/wal", manifest

    def _batch(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, rows: DataFrame) -> int:
        """Append valid store requests; returns how many. Unset and zero times become now, empty summaries null.

        The numbers are offsets by partition: rows are counted where they lie and never sorted or gathered. Another
        writer's commit in the meantime raises Conflict, and nothing is appended.
        """
        at = self.manifest.cursors()
        first = at.next_seq
        prepared = rows.select(
            "agent_id",
            "session_id",
            or_now(F.col("ts")).alias("ts"),
            "conversation_log",
            F.when(~is_blank(F.col("summary")), F.col("summary")).alias("summary"),
            F.monotonically_increasing_id().alias("__at"),
        )
        name = f"first={first:018d}-{files.tag()}"
        raw = f"{self.root}/_incoming-{name}"
        prepared.write.option("compression", "zstd").parquet(raw)
        written = self.spark.read.parquet(raw)
        part = F.shiftright("__at", 33)
        counts = written.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
        offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
        total = counts.agg(F.sum("__n")).first()[0] or 0
        if total:
            inside = F.col("__at") - F.shiftleft(part, 33)
            numbered = written.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            numbered = numbered.withColumn("wal_seq", F.lit(first) + F.col("__offset") + inside)
            numbered.select(*WAL.names).write.option("compression", "zstd").parquet(self._batch(name))
            try:
                self.manifest.commit(at, next_seq=first + total, wal_batches=(*at.wal_batches, (first, first + total - 1, name)))
            except Conflict:
                files.delete(self.spark, self._batch(name))
                files.delete(self.spark, raw)
                raise
        files.delete(self.spark, raw)
        return total

    def read(self, after: int | None = None, limit: int | None = None, at: Cursors | None = None) -> DataFrame:
        """Records beyond a sequence number, at most `limit` of them: a range of numbers, so no sort and whole files skipped."""
        at = at or self.manifest.cursors()
        low = max(at.trimmed_to, after if after is not None else at.trimmed_to)
        high = at.next_seq - 1 if limit is None else min(at.next_seq - 1, low + limit)
        batches = [self._batch(name) for a, b, name in at.wal_batches if b > low and a <= high]
        if not batches:
            return self.spark.createDataFrame([], WAL)
        rows = self.spark.read.schema(WAL).parquet(*batches)
        return rows.where((F.col("wal_seq") > low) & (F.col("wal_seq") <= high))

    def trim(self, upto: int) -> int:
        """Forget records up to a number that has been processed; batches without others are deleted. Returns how many went."""
        at = self.manifest.cursors()
        upto = min(upto, at.last_processed_seq)
        if upto <= at.trimmed_to:
            return 0
        gone = [x for x in at.wal_batches if x[1] <= upto]
        self.manifest.commit(at, trimmed_to=upto, wal_batches=tuple(x for x in at.wal_batches if x[1] > upto))
        for _, _, name in gone:
            files.delete(self.spark, self._batch(name))
        return upto - at.trimmed_to

    def count(self) -> int:
        return self.manifest.cursors().wal_records
