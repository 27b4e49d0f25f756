"""Bloom filters as binary columns: built by an aggregation, probed by an expression.

A filter is a row of bitmaps of BITMAP_BITS bits, each a bitmap_construct_agg value. Positions
come from xxhash64 with the hash number as salt, which gives the same value in every process.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap and, as a filter is read with its block's row, the most of a filter (2 MB).
BITMAP_BITS, MOST_BITS = 32768, 1 << 24


def size_for(distinct: int, false_positives: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for that many distinct values; bits are a power of two, at most MOST_BITS, which serve 1.7 million at 1 %."""
    distinct = max(1, distinct)
    wanted = -distinct * math.log(false_positives) / math.log(2) ** 2
    bits = min(MOST_BITS, max(64, 1 << math.ceil(math.log2(wanted))))
    return bits, max(1, min(16, round(bits / distinct * math.log(2))))


def positions(value: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def build(rows: DataFrame, group: str, value: str, bits: int, hashes: int, name: str) -> DataFrame:
    """group and its filter of value; bitmaps are merged before they are shuffled, and then put side by side."""
    at = rows.select(group, F.explode(positions(F.col(value), bits, hashes)).alias("__at"))
    which = F.floor(F.col("__at") / BITMAP_BITS).cast("int").alias("__n")
    maps = at.groupBy(group, which).agg(F.bitmap_construct_agg(F.pmod("__at", F.lit(BITMAP_BITS))).alias("__map"))
    pairs = maps.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("__n", "__map"))).alias("__maps"))
    none = F.unhex(F.repeat(F.lit("00"), BITMAP_BITS // 8))
    each = F.transform(F.sequence(F.lit(0), F.lit(max(1, bits // BITMAP_BITS) - 1)), lambda i: F.coalesce(F.col("__maps")[i], none))
    # concat() of hex texts, as there is no aggregate of binaries
    return pairs.select(group, F.unhex(F.array_join(F.transform(each, lambda b: F.hex(b)), "")).alias(name))


def may_contain(bloom: Column, value, bits: int, hashes: int) -> Column:
    """False only if the value is certainly not in the filter; a null filter may hold anything."""
    value = value if isinstance(value, Column) else F.lit(value)

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bloom, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1

    return bloom.isNull() | F.forall(positions(value, bits, hashes), is_set)
