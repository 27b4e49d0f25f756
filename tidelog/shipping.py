"""Prepares a session: the package in Spark's Python workers, and batches that fit beside them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch. Rows hold whole texts, and a batch lies in the executor and its Python worker at once.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def _bounded_batches(spark: SparkSession) -> None:
    now = spark.conf.get(_BATCH_SETTING, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    if not digits or (now or "").strip().lower() in (digits, f"{digits}b") and int(digits) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each application; cap Arrow batches that have the default size."""
    _bounded_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidelog-src-")) / "tidelog-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
