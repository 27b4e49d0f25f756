"""Expressions, embedders and summarizers."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom, scalar, summarize
from tidelog.functions.embed import ByteHistogramEmbedder, HashingEmbedder, ModelEmbedder, NormalisedEmbedder
from tidelog.operators import blocks as op
from tidelog.operators.filters import similar
from tidelog.operators.scoring import matching, matching_many


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_byte_histogram_golden(spark):
    embedder = ByteHistogramEmbedder()
    ask = embedder.vector(spark, "Did the build pass?")
    assert ask == [5, 3, 1, 2, 5, 2, 0, 1]
    for text, vector, score in (("build passes after updating tests", [6, 5, 2, 5, 7, 5, 2, 1], 103), ("random agent conversation", [2, 4, 2, 2, 3, 3, 5, 4], 53), ("héllo", [1, 1, 0, 1, 2, 0, 0, 1], 21)):
        assert embedder.vector(spark, text) == vector
        assert one(spark, scalar.inner_product(scalar.query_vector(ask), scalar.query_vector(vector))) == score


def test_normalisation(spark):
    unit = NormalisedEmbedder(ByteHistogramEmbedder()).vector(spark, "some text")
    assert abs(sum(x * x for x in unit) - 1) < 1e-6
    assert one(spark, scalar.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    vector = HashingEmbedder(64).vector(spark, "the same words")
    assert len(vector) == 64 and vector == HashingEmbedder(64).vector(spark, "words, the SAME") and abs(sum(x * x for x in vector) - 1) < 1e-6


def test_model_embedder(spark):
    embedder = ModelEmbedder(lambda: lambda texts: [[float(len(t)), 0.0] for t in texts], 2)
    assert embedder.vector(spark, "abc") == [1.0, 0.0]


def test_scores_and_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, [float("nan"), 1.0]), (4, [0.2, 5.0]), (5, [0.1, 0.0])], "id long, embedding array<float>")
    assert sorted(r["id"] for r in matching(rows, [1.0, 0.0], 0.19).collect()) == [1, 4]
    assert sorted(r["id"] for r in matching_many(rows, [("q", [1.0, 0.0])], 0.19).collect()) == [1, 4]
    assert one(spark, similar(F.lit(0.2), 0.2)) and not one(spark, similar(F.lit(float("nan")), 0.2))
    with pytest.raises(Exception, match="another length"):
        matching(rows, [1.0, 0.0, 0.0], 0.0).collect()
    assert matching(rows, [1.0, 0.0, 0.0], -9.0, strict=False).count() == 0


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("tidelog.operators.scoring.MOST_QUERIES", 3)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, embedding array<float>")
    vectors = [(f"q{k}", [1.0, -float(k)]) for k in range(7)]
    got = sorted((r["query_id"], r["id"]) for r in matching_many(rows, vectors, 0.0).collect())
    assert got == sorted((f"q{k}", i) for k in range(7) for i in range(5) if i >= k)
    assert matching_many(rows, [], 0.0).count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    bits, hashes = bloom.size_for(300)
    rows = spark.range(300).select((F.col("id") % 3).alias("b"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    blooms = bloom.build(rows, "b", "v", bits, hashes, "f")
    probe = lambda df: df.join(blooms, "b").select(bloom.may_contain(F.col("f"), F.col("v"), bits, hashes).alias("hit"))
    assert all(r["hit"] for r in probe(rows).collect())
    strangers = spark.range(3000).select((F.col("id") % 3).alias("b"), F.concat(F.lit("w"), F.col("id")).alias("v"))
    assert sum(r["hit"] for r in probe(strangers).collect()) < 60


def test_times(spark):
    got = one(spark, scalar.to_micros(scalar.from_proto_time(F.lit(5), F.lit(123456789))))
    assert got == 5_123456
    now = F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert one(spark, scalar.elapsed(now, F.lit(datetime(2023, 12, 31, 23, 59, 57, 500000, tzinfo=timezone.utc)))) == "2s"
    assert one(spark, scalar.elapsed(now, F.lit(None).cast("timestamp"))) == "N/A"
    assert one(spark, scalar.or_now(F.timestamp_micros(F.lit(0)), now)) == one(spark, now)


def test_text(spark):
    assert one(spark, scalar.event_text("sealed", block=F.lit(3), gone=F.lit(None).cast("int"), n=F.lit(10))) == "event=sealed block=3 n=10"
    assert one(spark, scalar.trim_ascii(F.lit(" \t\x0b\x0cfv\r\n"))) == "fv"
    assert one(spark, scalar.truncated(F.lit("abcdef"), 3)) == "abc..." and one(spark, scalar.truncated(F.lit("abc"), 3)) == "abc"
    for text in ('```json\n["a"]\n```', " plain ", "```", "```\nx", "``` a\nb ``` c ``` d", "x\n```\ny\n```", "```\n```"):
        assert one(spark, scalar.strip_code_fence(F.lit(text))) == summarize.strip_fence(text), text
    assert summarize.strip_fence("``` a\nb ``` c ``` d") == "b ``` c"
    assert one(spark, scalar.embedding_text(F.lit(""), F.lit("log"))) == "log" == one(spark, scalar.embedding_text(F.lit(None).cast("string"), F.lit("log")))


PAYLOADS = ["nonsense", '{"a":1}', "[]", '["a",1]', '["a"," "]', '```json\n["a", " b "]\n```', "7", "null"]


def test_summary_payloads_alike_in_both_places(spark):
    for payload in PAYLOADS:
        got = one(spark, scalar.summary_payload(F.lit(payload)))
        try:
            want = (summarize.parse_summaries(payload), None)
        except summarize.SummaryError as error:
            want = (None, str(error).split(":")[0])
        assert (got["summaries"], got["error"]) == want, payload


def test_responses_alike_in_both_places(spark):
    good = '{"candidates":[1,{"content":2},{"content":{"parts":[{"text":"a"},{"text":3},4,{"x":1}]}},{"content":{"parts":[{"text":"b"}]}}]}'
    assert one(spark, scalar.candidate_text(F.lit(good))) == summarize.parse_response(good) == "a\nb"
    for bad in ("x", "{}", '{"candidates":[]}', '{"candidates":[{"content":{"parts":[]}}]}', "[]"):
        assert one(spark, scalar.candidate_text(F.lit(bad))) is None
        with pytest.raises(summarize.SummaryError):
            summarize.parse_response(bad)


def test_remote_summarizer_retries():
    waits, calls = [], []

    def transport(body):
        calls.append(body)
        if len(calls) < 3:
            raise summarize.SummaryError("UNAVAILABLE", "busy")
        return '{"candidates":[{"content":{"parts":[{"text":"[\\"done\\"]"}]}}]}'

    assert summarize.RemoteSummarizer(transport, sleep=waits.append).summaries("a log") == ["done"]
    assert waits == [0.1, 0.2] and '"temperature": 0.1' in calls[0]

    def refuse(body):
        raise summarize.SummaryError("PERMISSION_DENIED", "no")

    with pytest.raises(summarize.SummaryError):
        summarize.RemoteSummarizer(refuse, sleep=waits.append).summaries("a log")
    assert len(waits) == 2
    retry, tried = summarize.Retry(attempts=6), []
    with pytest.raises(summarize.SummaryError):
        retry.call(lambda: (_ for _ in ()).throw(summarize.SummaryError("INTERNAL", "x")), tried.append)
    assert tried == [0.1, 0.2, 0.4, 0.5, 0.5]


def test_parts_of_logs(spark):
    assert summarize.parts("a b c") == ["a b c"]
    rng = random.Random(1)
    for _ in range(50):
        lines = [" ".join("w" for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(5, 30))]
        if rng.random() < 0.5:
            lines.insert(3, "```\n" + "code line\n" * 150 + "```")
        log = "\n".join(lines)
        out = summarize.parts(log)
        assert "".join(out) == log and all(p.count("```") in (0, 2) for p in out)
        assert (len(log.split()) <= summarize.SHORT_WORDS) == (len(out) == 1)
    rows = spark.createDataFrame([("x", "w " * 500), ("y", "short log"), ("z", None)], "id string, log string")
    got = summarize.exploded(rows, summarize.ExtractiveSummarizer(), "log").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {"x": 3, "y": 1}


def test_retention_rule():
    assert op.keep_last(31, 0, 30, 10, 12) == 20
    assert op.keep_last(31, 0, 5, 10, 12) == 5  # never beyond what is processed
    assert op.keep_last(21, 0, 20, 10) == 0 and op.keep_last(22, 0, 21, 10) == 11
    assert op.keep_last(31, 25, 30, 10, 12) == 25


def test_blooms_of_many_values_still_prune(spark):
    """Beyond one bitmap: none is missed, and few others are let through."""
    bits, hashes = bloom.size_for(20_000)
    assert bits > 4 * bloom.BITMAP_BITS
    rows = spark.range(40_000).select((F.col("id") % 2).alias("block"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    blooms = bloom.build(rows, "block", "v", bits, hashes, "b")
    other = spark.range(3000).select((F.col("id") * 13).alias("id"))
    hit = bloom.may_contain(F.col("b"), F.concat(F.lit("v"), F.col("id").cast("string")), bits, hashes)
    got = {(r[0], r[1]): r[2] for r in other.crossJoin(blooms).groupBy("block", (F.col("id") % 2 == F.col("block")).alias("member")).agg(F.avg(hit.cast("int"))).collect()}
    assert got[0, True] == got[1, True] == 1.0 and got[0, False] < 0.03 and got[1, False] < 0.03
