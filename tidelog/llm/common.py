"""What several operators share: staged tables, lean Python tasks, word hashing, a `let` for Spark lambdas."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import files


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidelog-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


def home(spark: SparkSession) -> str:
    """This application's folder among the shared ones."""
    return f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage, and a lost executor costs only the tasks that read the table. The table is
    columnar, so later steps read only the columns they use. The shuffle files behind it go as soon as it is
    written. The driver's JVM deletes all tables when it ends; release() does before.
    """
    spark = df.sparkSession
    folder = home(spark)
    if folder not in _homes:
        files.delete_on_exit(spark, folder)
        _homes.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a staged table before the application ends; nothing that is still to be computed may read it."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        files.delete(table.sparkSession, folder)


#: Spark else keeps an execution's shuffle files until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside delete their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_homes: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete the application's staged tables; results that were not written elsewhere can't be read afterwards."""
    files.delete(spark, home(spark))


_worker_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What one operator keeps in a Python worker from task to task; lean() drops the other operators'."""
    return _worker_caches.setdefault(owner, {})


def lean(fn: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """fn for mapInArrow or mapInPandas, whose worker gives memory back.

    Spark reuses Python workers for all stages that follow, so what one task leaves in an allocator or a
    cache would stand beside all later ones. Arrow takes its memory from the system's allocator here, caches
    of other operators go before the task, and free memory is returned after it.
    """

    def run(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        for other in [o for o in _worker_caches if o != owner]:
            del _worker_caches[other]
        try:
            yield from fn(batches)
        finally:
            _powers.clear()
            gc.collect()
            _trim()

    return run


def _trim() -> None:
    """Return free memory to the system, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also when body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def splittable(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with the same long keys, written so that a join on them shuffles rows anew.

    An aggregation's result is partitioned by its keys already, and a join that uses that partitioning
    can't have its hot keys split at run time. One more shuffle of the smaller side buys that.
    """
    return rows.withColumns({k: F.bitwise_not(F.bitwise_not(k)) for k in keys})


def set_aside(rows: DataFrame, used: list[str]):
    """(rows, restore): all columns but the used ones under names that clash with none, and a function that undoes this.

    restore takes a frame that still has these columns and selects the original ones, in order.
    """
    names = {c: c if c in used else f"__aside{i}" for i, c in enumerate(rows.columns)}

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(hidden).alias(c) for c, hidden in names.items()])

    return rows.toDF(*names.values()), restore


#: Places of a filter come in blocks of so many bits.
_BLOCK_BITS = 15


def _placed(batches: Iterator[pa.RecordBatch], bits: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """(block, places) of the values of a long or array<long> column: 15 bits of each distinct place, and one for "twice or more"."""
    held, size = [], 0

    def packed():
        place, n = np.unique(np.concatenate(held), return_counts=True)
        block = place >> np.uint32(_BLOCK_BITS)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        low = (place & np.uint32(0x7FFF)).astype("<u2") | (n > 1).astype("<u2") << np.uint16(15)
        offsets = pa.py_buffer(np.concatenate([2 * first, [2 * len(low)]]).astype(np.int32))
        places = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(low)])
        return pa.RecordBatch.from_pydict({"block": pa.array(block[first].astype(np.int32)), "places": places})

    for batch in batches:
        column = batch.column(0)
        values = (column.flatten() if pa.types.is_list(column.type) else column).to_numpy().view(np.uint64)
        place = values & np.uint64((1 << bits) - 1) if lower else values >> np.uint64(64 - bits)
        if len(place):
            held.append(place.astype(np.uint32))
            size += len(place)
        if size >= 1 << 21:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _block_bits(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The compressed bitmap of each block, from whole blocks."""
    blocks: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks.setdefault(block, []).append(places)
    for block, parts in blocks.items():
        places = np.frombuffer(b"".join(parts), "<u2")
        n = np.bincount(places & 0x7FFF, minlength=1 << _BLOCK_BITS)
        n[places[places >> 15 > 0] & 0x7FFF] += 1
        if (n >= least).any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": [zlib.compress(np.packbits(n >= least, bitorder="little").tobytes(), 1)]})


def filter_bits(rows: DataFrame, column: str, bits: int, least: int = 1, lower: bool = False) -> np.ndarray:
    """A bit for each value of the upper (or lower) `bits` bits, 15 to 32, of a column of longs or arrays of them: which of them occur.

    With least=2: which of them occur twice or more. Its size is fixed. However many values there are, it
    only ever lets too much through, so what passes must still be joined exactly.
    """
    placed = rows.select(column).mapInArrow(lean(lambda it: _placed(it, bits, lower)), "block int, places binary")
    with _without_shuffle_files(rows.sparkSession):
        blocks = placed.repartition("block").mapInArrow(lean(lambda it: _block_bits(it, least)), "block int, bits binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for block, part in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist(), strict=True):
        out[block << 12 : (block + 1) << 12] = np.frombuffer(zlib.decompress(part), np.uint8)
    return out


def with_row_info(docs: DataFrame, info: DataFrame, column: str, bits: int = 26) -> DataFrame:
    """docs (doc_id, text, text_hash, ...) with info's column by (doc_id, text_hash), or by text_hash if info has no doc_id.

    It is null where there is none. Only texts that may have info are shuffled; a filter of a fixed
    size finds them. doc_id may be null.
    """
    has = docs.sparkSession.sparkContext.broadcast(filter_bits(info, "text_hash", bits))

    def part(it, hit: bool):
        for batch in it:
            yield batch.filter(pa.array(may_hold(has.value, batch.column("text_hash").to_numpy()) == hit))

    plain = docs.mapInArrow(lean(lambda it: part(it, False)), docs.schema).withColumn(column, F.lit(None).cast(info.schema[column].dataType))
    found = docs.mapInArrow(lean(lambda it: part(it, True)), docs.schema)
    by_id = "doc_id" in info.columns
    right = info.select(F.col("doc_id" if by_id else "text_hash").alias("__id"), F.col("text_hash").alias("__hash"), column)
    same = F.col("text_hash") == F.col("__hash")
    if by_id:
        same &= F.col("doc_id").eqNullSafe(F.col("__id"))
    return plain.unionByName(found.join(right, same, "left").drop("__id", "__hash"))


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the long values have their bit set."""
    place = values.view(np.uint64) >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# 64-bit mixing constants (fixed values of the public splitmix64 finaliser)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly; another seed is another bijection."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: ASCII white space, which ends words.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Bytes of a text whose words are hashed at once.
_PIECE = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse): a stretch [a, b) of the bytes hashes to (sums[b] - sums[a]) * inverse[a], wherever it lies."""
    power, inverse = power_tables(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums, inverse


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, which are maximal runs without ASCII white space."""
    found, at = [], 0
    while at < len(text):
        stop = at + _PIECE
        if stop < len(text) and (space := _next_space(text, stop)) >= 0:
            stop = space
        else:
            stop = len(text)
        data = np.frombuffer(text[at:stop], np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums, inverse = prefix_sums(data)
        with np.errstate(over="ignore"):
            found.append(mix64((sums[ends] - sums[starts]) * inverse[starts]))
        at = stop
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _next_space(text: bytes, at: int) -> int:
    places = [p for c in b" \t\n\x0b\x0c\r" if (p := text.find(bytes([c]), at)) >= 0]
    return min(places, default=-1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of the text's k-word shingles, in order.

    A-Z count as lower case. A text of fewer than k words has its whole sequence as its one
    shingle; without words there is none.
    """
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    size = min(k, len(h))
    n = len(h) - size + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
            out += h[i : i + n]
    return mix64(out, size)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    h = np.sort(shingles(text, k))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
