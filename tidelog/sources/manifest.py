"""The manifest: which blocks exist, in which state, with which statistics, and the cursors of the jobs.

Each commit is a version. It appends the changed block rows as a small table and then, in one step that only one
writer can make, the version's file, which names the tables and batches in force and holds the cursors. Readers take
the newest version file and so always see one consistent snapshot. All folders have names of their own, so a writer
that loses a race has touched nothing of the winner's; it gets an error, and what it wrote goes.
Every SNAPSHOT_EVERY versions all rows are rewritten into one table, so a reader opens few.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.sources import files
from tidelog.sources.schemas import ACTIVE, BAKED, BLOCKS, FRESH, READY, SEALED

SNAPSHOT_EVERY = 16
_ROWS = StructType([*BLOCKS.fields, StructField("changed", LongType(), False)])


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Cursors:
    """What is not a block. Sequence numbers start at 1 and have no gaps; times are microseconds."""

    version: int = 0
    tables: tuple[str, ...] = ()
    next_seq: int = 1
    last_processed_seq: int = 0
    trimmed_to: int = 0
    next_block_id: int = 1
    wal_batches: tuple[tuple[int, int, str], ...] = ()  # first and last number, folder
    fresh_batches: tuple[str, ...] = ()
    last_ingestion_run: int | None = None
    last_compaction_run: int | None = None

    @property
    def wal_records(self) -> int:
        """Records in the write-ahead table: all that were appended but not trimmed."""
        return self.next_seq - 1 - self.trimmed_to


@dataclass
class Manifest:
    spark: SparkSession
    root: str
    _seen: dict = field(default_factory=dict)

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        files.make_folder(self.spark, f"{self.root}/versions")

    def cursors(self) -> Cursors:
        """The newest version; the initial one if there is none."""
        found = [int(n[:-5]) for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        if not found:
            return Cursors()
        newest = max(found)
        if newest not in self._seen:
            raw = json.loads(files.read_text(self.spark, f"{self.root}/versions/{newest:012d}.json"))
            raw["tables"], raw["fresh_batches"] = tuple(raw["tables"]), tuple(raw["fresh_batches"])
            raw["wal_batches"] = tuple(map(tuple, raw["wal_batches"]))
            self._seen = {newest: Cursors(**raw)}
        return self._seen[newest]

    def blocks(self, at: Cursors | None = None) -> DataFrame:
        """The blocks of a snapshot, one row each: the latest change counts."""
        at = at or self.cursors()
        if not at.tables:
            return self.spark.createDataFrame([], BLOCKS)
        rows = self.spark.read.schema(_ROWS).parquet(*[self._table(v) for v in at.tables])
        if len(at.tables) > 1:
            latest = rows.groupBy("block_id").agg(F.max_by(F.struct(*rows.columns), "changed").alias("r"))
            rows = latest.select("r.*")
        return rows.select(*BLOCKS.names)

    def commit(self, before: Cursors, changed: DataFrame | None = None, **cursors) -> Cursors:
        """A new version after `before`, with changed block rows and cursors."""
        version = before.version + 1
        tables = before.tables
        if changed is not None:
            if len(tables) >= SNAPSHOT_EVERY:
                keys = changed.select("block_id")
                changed = self.blocks(before).join(F.broadcast(keys) if self._few(keys) else keys, "block_id", "left_anti").select(*BLOCKS.names).unionByName(changed.select(*BLOCKS.names))
                tables = ()
            rows = changed.select(*[F.col(f.name).cast(f.dataType) for f in BLOCKS.fields], F.lit(version).cast("long").alias("changed"))
            made = f"v{version:012d}-{files.tag()}"
            rows.write.option("compression", "zstd").parquet(self._table(made))
            tables = (*tables, made)
        after = replace(before, version=version, tables=tables, **cursors)
        if not files.write_new(self.spark, f"{self.root}/versions/{version:012d}.json", json.dumps(asdict(after))):
            if changed is not None:
                files.delete(self.spark, self._table(made))
            raise Conflict(f"version {version} exists already")
        return after

    def _few(self, keys: DataFrame) -> bool:
        return len(keys.limit(10_001).collect()) <= 10_000

    def _table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"


# ---- what is in force


def live(blocks: DataFrame) -> DataFrame:
    """Blocks that hold records for queries: baked ones and those not yet baked."""
    baked = (F.col("block_type") == BAKED) & (F.col("state") == READY)
    fresh = (F.col("block_type") == FRESH) & F.col("state").isin(ACTIVE, SEALED)
    return blocks.where(baked | fresh)


def latest_active(blocks: DataFrame) -> DataFrame:
    """The active fresh block with the largest id, if there is one."""
    return blocks.where((F.col("block_type") == FRESH) & (F.col("state") == ACTIVE)).orderBy(F.desc("block_id")).limit(1)
