"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The jump sequence of a key is a strictly increasing series of shard numbers; with n shards, a key
lives in the last member below n. So one more shard takes rows only into itself, about 1/(n+1) of
all, and no ring table is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.llm.common import staged

#: The multiplier of the published algorithm's 64-bit linear congruential generator (fixed value).
MULTIPLIER = 2862933555777941757
MASK = (1 << 32) - 1
#: Shards times slot buckets that may be broadcast.
BROADCAST_GROUPS = 100_000


def key_words(*columns: str) -> tuple[Column, Column]:
    """High and low 32 bits of a stable 64-bit key, from the MD5 of the columns as strings (null as empty)."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return part(1), part(9)


def _next(state: Column) -> Column:
    """One step: key = key * MULTIPLIER + 1 modulo 2^64 in 32-bit halves, none of whose products overflows a long."""
    mul_hi, mul_lo = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & MASK)
    hi, lo, at = state["hi"], state["lo"], state["next"]
    low16 = lambda c: c.bitwiseAND(F.lit(0xFFFF))
    upper = F.shiftright(lo, 16) * mul_lo
    x = low16(lo) * mul_lo + F.shiftleft(low16(upper), 16) + F.lit(1)
    hi_mul = low16(hi) * mul_lo + F.shiftleft(low16(F.shiftright(hi, 16) * mul_lo), 16)
    new_hi = (F.shiftright(x, 32) + F.shiftright(upper, 16) + hi_mul + lo * mul_hi).bitwiseAND(F.lit(MASK))
    new_lo = x.bitwiseAND(F.lit(MASK))
    jump = (at + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1).cast("double"))
    return F.struct(
        new_hi.alias("hi"), new_lo.alias("lo"), state["at"].alias("before"), at.alias("at"), F.floor(jump).cast("long").alias("next")
    )


def jump_state(hi: Column, lo: Column, shards: int) -> Column:
    """A struct whose `at` is the last member of the jump sequence below shards, and `before` the one before it.

    The sequence nearly always ends within a few times ln(shards) steps; a row that needs more goes
    on, up to `shards` steps, which always suffice.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    zero, less = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), less.alias("before"), less.alias("at"), zero.alias("next"))
    step = lambda s, _: F.when(s["next"] < shards, _next(s)).otherwise(s)
    quick = min(shards, 8 + 2 * math.ceil(math.log(shards + 1)))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(quick)), start, step)
    return F.element_at(
        F.transform(
            F.array(first),
            lambda s: F.aggregate(F.when(s["next"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>")), s, step),
        ),
        1,
    )


def with_shard(df: DataFrame, keys: list[str], shards: int, to: str = "shard", grown: str | None = None) -> DataFrame:
    """df with each row's shard in column `to`, and in `grown` its shard if there were one more.

    Equal keys always share a shard; null keys count as empty strings, and so share one. Columns
    of other names are kept as they are; a column named `to` or `grown` is replaced.
    """
    hi, lo = key_words(*keys)
    state = "__jump_state"
    out = df.withColumn(state, jump_state(hi, lo, shards + 1))
    at, before = F.col(state)["at"], F.col(state)["before"]
    out = out.withColumn(to, F.when(at == shards, before).otherwise(at).cast("int"))
    if grown:
        out = out.withColumn(grown, at.cast("int"))
    return out.drop(state)


def shard_documents(docs: DataFrame, shards: int = 40, slot_buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text).

    A slot is a row's gapless place in its shard, in the order of (bucket, doc_id, text_crc32,
    size), where the bucket comes from those three values. Rows equal in all three are counted
    before they are shuffled, so that no repeated row, null key or hot text makes a hot group; they
    get slots one after another. A shard's numbering is split over slot_buckets groups, whose
    offsets are sums of counts, at most shards * slot_buckets rows.

    Nulls: a null text has size 16 and the checksum of no bytes, 0; null doc_ids share one shard,
    and their rows come first in their bucket. An empty table gives an empty result. Other columns
    of docs are ignored.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    _, lo = key_words("doc_id")
    rows = with_shard(rows, ["doc_id"], shards, "shard", "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(lo + F.col("text_crc32") + F.col("size"), F.lit(slot_buckets)).cast("int"))
    rows = staged(rows, "shards")  # some tens of bytes a row, so that texts are read once

    sums = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("in_bucket"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("offset"))
    if shards * slot_buckets <= BROADCAST_GROUPS:
        offsets = F.broadcast(offsets)
    inside = (
        Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("first") + F.col("copy") - 1).alias("slot"),
        "grown_shard",
    )
