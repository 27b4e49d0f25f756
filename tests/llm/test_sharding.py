import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidelog.llm.sharding import MULTIPLIER, shard_documents, with_shard


def jump(key: int, n: int) -> int:
    """The published algorithm."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(value) -> int:
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:16], 16)


def test_equals_the_published_algorithm(spark):
    for n in (1, 2, 40, 1000):
        got = with_shard(spark.range(2000), ["id"], n, "s", "t").collect()
        assert all(r["s"] == jump(key_of(r["id"]), n) and r["t"] == jump(key_of(r["id"]), n + 1) for r in got)


def test_rows_that_need_more_than_the_quick_steps(spark, monkeypatch):
    from tidelog.llm import sharding

    monkeypatch.setattr(sharding.math, "log", lambda x: -3.0)  # two quick steps
    got = sharding.with_shard(spark.range(500), ["id"], 40, "s").collect()
    assert all(r["s"] == jump(key_of(r["id"]), 40) for r in got)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = with_shard(spark.range(5000), ["id"], 40, "s", "t").collect()
    moved = [r for r in rows if r["s"] != r["t"]]
    assert all(r["t"] == 40 for r in moved) and 60 < len(moved) < 200


def test_slots_and_digests(spark, documents):
    got = shard_documents(documents).collect()
    assert len(got) == documents.count()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_odd_rows(spark, odd_documents):
    got = shard_documents(odd_documents).collect()
    assert len(got) == 9 and Counter(r["doc_id"] for r in got)[1] == 2
    null_text = next(r for r in got if r["doc_id"] == 2)
    assert (null_text["size"], null_text["text_crc32"]) == (16, 0)
    assert next(r for r in got if r["doc_id"] is None)["shard"] == jump(key_of(None), 40)
    assert shard_documents(odd_documents.limit(0)).count() == 0


def test_hot_repeated_row_gets_gapless_slots(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shard_documents(rows).collect()
    assert sorted(r["slot"] for r in got) == list(range(3000)) and len({r["shard"] for r in got}) == 1
