"""Behaviour of the log store, scenario by scenario."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidelog.config import LogConfig
from tidelog.engine import LogStore
from tidelog.functions.embed import ByteHistogramEmbedder
from tidelog.operators.filters import LogQuery, candidate_blocks
from tidelog.plans.query import COMPLETE, INCOMPLETE, INTERNAL_ERROR, result_status
from tidelog.plans.status import respond
from tidelog.sources.manifest import Conflict
from tidelog.sources.schemas import BAKED, STORE

T0 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
HIT, MISS, ASK = "build passes after updating tests", "random agent conversation", "Did the build pass?"


def store(spark, path, size=10, threshold=100.0, trim=20, **more):
    config = LogConfig(max_records_per_block=size, similarity_threshold=threshold, wal_trim_threshold=trim, **more)
    return LogStore(spark, f"file://{path}", ByteHistogramEmbedder(), config)


def fill(spark, s, rows):
    s.store(spark.createDataFrame([(*r, None) if len(r) == 4 else r for r in rows], STORE).coalesce(1))
    s.ingest_all()
    s.compact()


def rows_of(total, hits, agents, sessions, seed=7):
    out = [(f"agent_{i % agents}", f"session_{i % sessions}", HIT if i < hits else MISS, T0 + timedelta(seconds=i)) for i in range(total)]
    random.Random(seed).shuffle(out)
    return out


def three(spark, path):
    s = store(spark, path, size=1, threshold=-1.0)
    fill(spark, s, [(f"agent_{c}", f"session_{i + 1}", f"conversation {n}", T0 + timedelta(seconds=i)) for i, (c, n) in enumerate(zip("abc", ("one", "two", "three")))])
    return s


def test_three_rows_with_each_filter(spark, tmp_path):
    s = three(spark, tmp_path)
    ask = lambda **f: sorted(r["agent_id"] for r in s.query(LogQuery("me", ASK, **f)).df.collect())
    assert ask() == ["agent_a", "agent_b", "agent_c"]
    assert ask(agent_id="agent_b") == ["agent_b"]
    assert ask(session_id="session_3") == ["agent_c"]
    at = T0 + timedelta(seconds=1)
    assert ask(start_time=at, end_time=at) == ["agent_b"]
    at = T0 + timedelta(seconds=2)
    assert ask(agent_id="agent_c", session_id="session_3", start_time=at, end_time=at) == ["agent_c"]
    assert ask(agent_id="") == [] and ask(start_time=at, end_time=T0) == []
    found = s.query(LogQuery("me", ASK))
    assert found.status == COMPLETE and found.df.columns == ["agent_id", "session_id", "timestamp", "raw_conversation_log"]


def test_query_validation(spark, tmp_path):
    s = store(spark, tmp_path)
    for bad in (LogQuery("", ASK), LogQuery("me", "")):
        with pytest.raises(ValueError, match="INVALID_ARGUMENT"):
            s.query(bad)
    nothing = s.query(LogQuery("me", ASK))
    assert nothing.status == COMPLETE and nothing.df.count() == 0


def test_store_validation(spark, tmp_path):
    s = store(spark, tmp_path)
    for bad in (("", "s", "l"), ("a", "", "l"), ("a", "s", "")):
        assert s.store_one(*bad)[0] == "INVALID_ARGUMENT"
    assert s.wal.count() == 0 and s.store_one("a", "s", "l") == ("OK", "")
    assert s.wal.count() == 1
    row = s.wal.read().first()
    assert abs((datetime.now() - row["ts"]).total_seconds()) < 600 and row["summary"] is None


def test_small_and_large_query(spark, tmp_path):
    s = store(spark, tmp_path / "small")
    fill(spark, s, rows_of(18, 3, 3, 4))
    found = s.query(LogQuery("me", ASK)).df.collect()
    assert len(found) == 3 and {r["raw_conversation_log"] for r in found} == {HIT}
    s = store(spark, tmp_path / "large")
    fill(spark, s, rows_of(160, 12, 7, 9))
    assert s.query(LogQuery("me", ASK)).df.count() == 12
    assert s.manifest.blocks().where("block_type = 'BAKED'").count() == 16
    assert s.query_many({"x": ASK, "y": MISS}).groupBy("query_id").count().collect()


def test_pruning_loses_nothing(spark, tmp_path):
    rows = [(f"other_agent_{1 + i % 6}", f"other_session_{1 + i % 8}", MISS, T0 + timedelta(seconds=i)) for i in range(116)]
    rows += [("target_agent", "target_session", HIT, T0 + timedelta(hours=24, seconds=i)) for i in range(4)]
    s = store(spark, tmp_path)
    fill(spark, s, rows)
    blocks = s.manifest.blocks()
    count = lambda **f: candidate_blocks(blocks, LogQuery("me", ASK, **f), *s.bloom_size).where(f"block_type = '{BAKED}'").count()
    for f in ({"agent_id": "target_agent"}, {"session_id": "target_session"}, {"start_time": T0 + timedelta(hours=23)}):
        assert 0 < count(**f) < count()
        assert s.query(LogQuery("me", ASK, **f)).df.count() == 4
    assert count(agent_id="absent") == 0 and count(session_id="absent") == 0
    plan = s.query(LogQuery("me", ASK, agent_id="target_agent")).df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(agent_id,target_agent)" in plan and "Exchange" not in plan
    for r in range(1, 7):  # a filter's own members are always candidates
        assert s.query(LogQuery("me", MISS, agent_id=f"other_agent_{r}")).df.count() >= 0
        assert count(agent_id=f"other_agent_{r}") > 0


def test_block_lifecycle(spark, tmp_path):
    s = store(spark, tmp_path)
    data = rows_of(14, 0, 2, 2)
    s.store(spark.createDataFrame([(*r, None) for r in data], STORE))
    assert s.wal.count() == 14
    assert s.query(LogQuery("me", MISS)).df.count() == 0  # not ingested yet
    assert s.ingest_all() == 14 and s.ingest() == 0
    states = {r["block_id"]: (r["state"], r["record_count"]) for r in s.manifest.blocks().collect()}
    assert sorted(states.values()) == [("ACTIVE", 4), ("SEALED", 10)]
    # a new store object continues where the first stopped
    again = store(spark, tmp_path)
    assert again.compact() == 1 and again.compact() == 0
    baked = again.manifest.blocks().where("block_type = 'BAKED'").collect()
    assert [(b["record_count"], b["state"]) for b in baked] == [(10, "READY")]
    ordered = [tuple(r) for r in again.blocks.read_baked([baked[0]["block_path"]]).select("ts", "agent_id", "session_id").collect()]
    assert ordered == sorted(ordered)
    fill(spark, again, rows_of(6, 0, 2, 2))
    assert sorted((r["block_type"], r["state"], r["record_count"]) for r in again.manifest.blocks().where("state <> 'COMPACTED'").collect()) == [
        ("BAKED", "READY", 10),
        ("BAKED", "READY", 10),
    ]
    assert again.status().first()["total_records"] == 20
    before = again.query(LogQuery("me", MISS)).df.count()
    again.vacuum()
    assert again.query(LogQuery("me", MISS)).df.count() == before


def test_small_batches_fill_blocks_exactly(spark, tmp_path):
    s = store(spark, tmp_path, wal_read_batch=7)
    s.store(spark.createDataFrame([(*r, None) for r in rows_of(33, 0, 2, 2)], STORE))
    s.ingest_all()
    counts = [r["record_count"] for r in s.manifest.blocks().orderBy("block_id").collect()]
    assert counts == [10, 10, 10, 3]


def test_trim_keeps_unprocessed_records(spark, tmp_path):
    s = store(spark, tmp_path, trim=12)
    for part in (rows_of(15, 0, 2, 2), rows_of(15, 0, 2, 2)):
        s.store(spark.createDataFrame([(*r, None) for r in part], STORE))
    assert s.trim_wal() == 0 and s.wal.count() == 30
    s.ingest_all()
    assert s.wal.count() == 10 and s.wal.read().count() == 10
    assert s.status().first()["total_records"] == 30


def test_writers_conflict(spark, tmp_path):
    s = store(spark, tmp_path)
    at = s.manifest.cursors()
    s.manifest.commit(at, next_seq=1)
    with pytest.raises(Conflict):
        s.manifest.commit(at, next_seq=1)


def test_many_versions(spark, tmp_path):
    s = store(spark, tmp_path, size=2, trim=1000)
    for i in range(20):
        s.store_one("a", "s", MISS, T0 + timedelta(seconds=i))
        s.ingest()
    assert len(s.manifest.cursors().tables) <= 17
    assert s.status().first()["total_records"] == 20
    assert s.manifest.blocks().count() == 10


def test_identical_payloads_are_all_returned(spark, tmp_path):
    s = store(spark, tmp_path, size=50, threshold=-1.0)
    fill(spark, s, [("fixed", "fixed", "long text " * 50, T0)] * 3 + [(f"a{i}", f"s{i}", "long text " * 50, T0) for i in range(27)])
    assert s.query(LogQuery("me", ASK, agent_id="fixed", session_id="fixed")).df.count() == 3


def test_summary_is_embedded_and_dropped(spark, tmp_path):
    s = store(spark, tmp_path)
    fill(spark, s, [("a", "1", MISS, T0, HIT), ("a", "2", HIT, T0, ""), ("a", "3", MISS, T0, None)])
    assert sorted(r["session_id"] for r in s.query(LogQuery("me", ASK)).df.collect()) == ["1", "2"]


def test_deadline_and_status_matrix(spark, tmp_path):
    s = three(spark, tmp_path)
    found = s.query(LogQuery("me", ASK), deadline=True)
    assert found.status == COMPLETE and found.df.count() == 3
    assert result_status(4, 0, 1, 5, 50, 9) == INCOMPLETE
    assert result_status(4, 0, 0, 51, 50, 9) == INCOMPLETE
    assert result_status(4, 4, 0, 5, 50, 0) == INTERNAL_ERROR
    assert result_status(4, 3, 0, 5, 50, 0) == COMPLETE
    assert result_status(0, 0, 0, 5, 50, 0) == COMPLETE


def test_embedder_failure_is_an_error(spark, tmp_path):
    s = store(spark, tmp_path)
    s.embedder = None
    assert s.query(LogQuery("me", ASK)).status == INTERNAL_ERROR


def test_status_page(spark, tmp_path):
    s = store(spark, tmp_path)
    assert "No baked blocks" in respond(s, "/statusz")[1] and "N/A" in respond(s, "/statusz?x=1")[1]
    fill(spark, s, rows_of(14, 0, 2, 2))
    code, page = respond(s, "/statusz")
    assert code == 200 and "Records ingested: 14" in page and "<td>10</td>" in page
    assert respond(s, "/other")[0] == 404
    s.manifest = None
    assert respond(s, "/statusz")[0] == 500


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    from tidelog.streaming.ingest import folder_stream, ingest_stream, store_batch

    data = rows_of(40, 6, 3, 4)
    source = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame([(*r, None) for r in data[i * 10 : i * 10 + 10]], STORE).coalesce(1).write.mode("append").parquet(f"file://{source}")
    s = store(spark, tmp_path / "s")
    ingest_stream(s, folder_stream(spark, f"file://{source}", 1), f"file://{tmp_path / 'cp'}").awaitTermination(120)
    assert s.status().first()["total_records"] == 40 and s.query(LogQuery("me", ASK)).df.count() == 6
    store_batch(s, spark.createDataFrame([(*r, None) for r in data[:10]], STORE), 0, "default")  # a repeated batch
    assert s.status().first()["total_records"] == 40
    ingest_stream(s, folder_stream(spark, f"file://{source}", 1), f"file://{tmp_path / 'cp'}").awaitTermination(120)
    assert s.status().first()["total_records"] == 40


def test_random_filters_equal_a_plain_scan(spark, tmp_path):
    """Pruning by time and blooms never loses a row, whatever the filters."""
    rng = random.Random(11)
    data = [(f"agent_{rng.randrange(9)}", f"session_{rng.randrange(7)}", rng.choice([HIT, MISS]), T0 + timedelta(seconds=rng.randrange(2000))) for _ in range(150)]
    s = store(spark, tmp_path, size=12)
    s.store(spark.createDataFrame([(*r, None) for r in data], STORE))
    s.ingest(70)
    s.compact()
    s.ingest_all()  # baked, sealed and active blocks side by side
    for _ in range(12):
        f = {}
        if rng.random() < 0.5:
            f["agent_id"] = f"agent_{rng.randrange(11)}"
        if rng.random() < 0.5:
            f["session_id"] = f"session_{rng.randrange(9)}"
        if rng.random() < 0.6:
            f["start_time"] = T0 + timedelta(seconds=rng.randrange(2000))
        if rng.random() < 0.6:
            f["end_time"] = T0 + timedelta(seconds=rng.randrange(2000))
        want = sorted(
            (a, b, t.replace(tzinfo=None))
            for a, b, log, t in data
            if log == HIT and f.get("agent_id", a) == a and f.get("session_id", b) == b and f.get("start_time", t) <= t <= f.get("end_time", t)
        )
        got = sorted((r[0], r[1], r[2]) for r in s.query(LogQuery("me", ASK, **f)).df.collect())
        assert got == want, f


def test_a_writer_that_loses_leaves_the_winners_rows(spark, tmp_path):
    """Both have read the same version; whatever the loser does, the winner's rows are what is read."""
    winner, loser = store(spark, tmp_path, size=2, threshold=-1.0, trim=100), store(spark, tmp_path, size=2, threshold=-1.0, trim=100)
    for action in ("store", "ingest", "compact"):
        old = loser.manifest.cursors()
        if action == "store":
            winner.store(spark.createDataFrame([("a", "s", f"winner {i}", T0, None) for i in range(4)], STORE).coalesce(1))
        else:
            getattr(winner, action)()
        loser.manifest.cursors = lambda old=old: old
        with pytest.raises(Conflict):
            if action == "store":
                loser.store_one("b", "s", "loser")
            else:
                getattr(loser, action)()
        del loser.manifest.cursors
        assert sorted(r["conversation_log"] for r in loser.wal.read().collect()) == [f"winner {i}" for i in range(4)]
    assert sorted(r["raw_conversation_log"] for r in loser.query(LogQuery("me", ASK)).df.collect()) == [f"winner {i}" for i in range(4)]
