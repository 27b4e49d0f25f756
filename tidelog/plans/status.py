"""The status view: totals, blocks and jobs."""

from __future__ import annotations

from datetime import datetime, timezone
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.sources.manifest import latest_active, live
from tidelog.sources.schemas import BAKED, READY


def total_ingested(blocks: DataFrame) -> DataFrame:
    """One row: records in baked blocks and in fresh ones that are not baked yet, so that none counts twice."""
    return live(blocks).agg(F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("total_records"))


def active_records(blocks: DataFrame) -> DataFrame:
    """One row: records of the active block, 0 without one."""
    return latest_active(blocks).agg(F.coalesce(F.max("record_count"), F.lit(0)).cast("long").alias("fresh_records"))


def baked_blocks(blocks: DataFrame) -> DataFrame:
    found = blocks.where((F.col("block_type") == BAKED) & (F.col("state") == READY))
    return found.select("block_id", "record_count").orderBy("block_id")


def elapsed_text(now_micros: int, then_micros: int | None) -> str:
    return "N/A" if then_micros is None else f"{(now_micros - then_micros) // 1_000_000}s"


def snapshot(manifest) -> DataFrame:
    """One row: totals, write-ahead records and both jobs' last runs in microseconds."""
    at = manifest.cursors()
    blocks = manifest.blocks(at)
    return total_ingested(blocks).crossJoin(active_records(blocks)).select(
        "total_records",
        F.lit(at.wal_records).cast("long").alias("wal_records"),
        "fresh_records",
        F.lit(at.last_ingestion_run).cast("long").alias("last_ingestion_run"),
        F.lit(at.last_compaction_run).cast("long").alias("last_compaction_run"),
    )


def render(row, blocks: list, now: datetime | None = None) -> str:
    """The status as an HTML page."""
    micros = int((now or datetime.now(timezone.utc)).timestamp() * 1_000_000)
    facts = {
        "Records ingested": row["total_records"],
        "Records in the write-ahead table": row["wal_records"],
        "Records in the active block": row["fresh_records"],
        "Since the last ingestion run": elapsed_text(micros, row["last_ingestion_run"]),
        "Since the last compaction run": elapsed_text(micros, row["last_compaction_run"]),
    }
    lines = "".join(f"<li>{escape(k)}: {escape(str(v))}</li>" for k, v in facts.items())
    cells = "".join(f"<tr><td>{b['block_id']}</td><td>{b['record_count']}</td></tr>" for b in blocks)
    cells = cells or "<tr><td colspan='2'>No baked blocks</td></tr>"
    head = "<!doctype html><html><head><meta charset='utf-8'><title>tidelog status</title></head>"
    return f"{head}<body><h1>Status</h1><ul>{lines}</ul><h2>Baked blocks</h2><table><tr><th>Block</th><th>Records</th></tr>{cells}</table></body></html>"


def respond(store, path: str) -> tuple[int, str]:
    """(HTTP status, body) of a GET: the page at /statusz with or without a query string, 404 elsewhere, 500 if it fails."""
    if path != "/statusz" and not path.startswith("/statusz?"):
        return 404, "not found"
    try:
        return 200, store.status_page()
    except Exception as error:  # noqa: BLE001 - the page must answer
        return 500, escape(str(error).splitlines()[0] if str(error) else type(error).__name__)
