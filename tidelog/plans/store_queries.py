"""Queries that run the store itself: every row is written to a store in the shared folder and read through its classes."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import LogConfig
from tidelog.engine import LogStore
from tidelog.functions import scalar, summarize
from tidelog.functions.embed import ByteHistogramEmbedder
from tidelog.operators.filters import LogQuery
from tidelog.operators.scoring import matching
from tidelog.plans.catalog import ASK, EVENTS, HISTOGRAM, SIZE, T0, T1, _table, _vector_zero, event_wal, query, scratch, vector_records
from tidelog.plans.status import respond
from tidelog.sources import files
from tidelog.sources.manifest import Conflict
from tidelog.sources.schemas import RECORDS
from tidelog.streaming.ingest import folder_stream, ingest_stream, store_batch

REQUEST = ("agent_id", "session_id", "conversation_log", "ts", "summary")
HITS = f"WITH {EVENTS}, h AS (SELECT *, {HISTOGRAM.format(t='log')} AS v FROM e) SELECT {{columns}} FROM h WHERE list_inner_product(v::DOUBLE[], [5, 3, 1, 2, 5, 2, 0, 1]::DOUBLE[]) >= 40"
_RESULT = "agent_id, session_id, ts AS timestamp, log AS raw_conversation_log"
_stores: dict[tuple[str, str], LogStore] = {}


def _open(spark: SparkSession, **config) -> LogStore:
    settings = {"max_records_per_block": SIZE, "wal_read_batch": 50_000, "wal_trim_threshold": 1 << 40, "similarity_threshold": 40.0} | config
    return LogStore(spark, scratch(spark), ByteHistogramEmbedder(), LogConfig(**settings))


def _append(store: LogStore, spark: SparkSession, sf_dir: str) -> int:
    wal = event_wal(spark, sf_dir).orderBy("wal_seq")
    store.store(wal.select(*REQUEST))
    return store.wal.count()


def half_baked(spark: SparkSession, sf_dir: str) -> LogStore:
    """A store of all events, the full blocks of whose first half are baked; one for all queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = _open(spark)
        n = _append(store, spark, sf_dir)
        store.ingest(n // 2)
        store.compact()
        store.ingest_all()
        _stores[key] = store
    return _stores[key]


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(HITS.format(columns=_RESULT))
def store_query(spark, sf_dir):
    """One query over baked, sealed and active blocks."""
    return _plain(half_baked(spark, sf_dir).query(LogQuery("me", ASK)).df)


@query(HITS.format(columns=_RESULT) + " AND agent_id = 'agent_7' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def store_query_filtered(spark, sf_dir):
    q = LogQuery("me", ASK, agent_id="agent_7", start_time=T0, end_time=T1)
    return _plain(half_baked(spark, sf_dir).query(q).df)


@query(HITS.format(columns=_RESULT + ", 'COMPLETE' AS status") + " AND session_id = 's_error'")
def store_query_deadline(spark, sf_dir):
    """Dealt to jobs that write their rows; all are done in time."""
    found = half_baked(spark, sf_dir).query(LogQuery("me", ASK, session_id="s_error"), deadline=True)
    return _plain(found.df).withColumn("status", F.lit(found.status))


@query(f"""WITH {EVENTS}, q AS (SELECT * FROM (VALUES ('short', 'ok?'), ('ask', '{ASK}')) t(query_id, text)),
v AS (SELECT query_id, {HISTOGRAM.format(t='text')} AS a FROM q), h AS (SELECT *, {HISTOGRAM.format(t='log')} AS b FROM e)
SELECT query_id, agent_id, count(*) AS n FROM v, h WHERE list_inner_product(a::DOUBLE[], b::DOUBLE[]) >= 40 GROUP BY ALL""")
def store_query_many(spark, sf_dir):
    """Two texts in one scan, their hits counted by agent."""
    hits = half_baked(spark, sf_dir).query_many({"short": "ok?", "ask": ASK})
    return hits.groupBy("query_id", "agent_id").agg(F.count(F.lit(1)).alias("n"))


def _live(store: LogStore) -> DataFrame:
    from tidelog.sources.manifest import live

    at = store.manifest.cursors()
    return store.blocks.read(live(store.manifest.blocks(at)), at)


@query(HITS.format(columns="wal_seq, log AS raw_conversation_log"))
def store_payloads(spark, sf_dir):
    """Keys and vectors by a narrow scan of the store's files, the logs of the hits by a second one."""
    store = half_baked(spark, sf_dir)
    records = _live(store)
    hits = matching(store.blocks.index(records), [5.0, 3.0, 1.0, 2.0, 5.0, 2.0, 0.0, 1.0], 40.0).select("block_id", "wal_seq")
    return store.blocks.payloads(hits, records).select("wal_seq", "raw_conversation_log")


@query(f"WITH {EVENTS} SELECT wal_seq, agent_id, log AS conversation_log FROM e WHERE wal_seq > 300 ORDER BY wal_seq LIMIT 200")
def store_wal_read(spark, sf_dir):
    return half_baked(spark, sf_dir).wal.read(after=300, limit=200).select("wal_seq", "agent_id", "conversation_log")


@query("SELECT count(*) AS wal_records, count(DISTINCT concat_ws(' ', event_type, props)) AS distinct_logs FROM events")
def store_wal_count(spark, sf_dir):
    store = half_baked(spark, sf_dir)
    return _live(store).agg(F.countDistinct("raw_conversation_log").alias("distinct_logs")).withColumn("wal_records", F.lit(store.wal.count()).cast("long"))


@query(f"WITH {EVENTS} SELECT wal_seq, session_id FROM e WHERE wal_seq > (SELECT max(wal_seq) FROM e) - 250")
def store_wal_retention(spark, sf_dir):
    """Ingestion trims the write-ahead table beyond its threshold, down to a block's size."""
    store = _open(spark, max_records_per_block=250, wal_trim_threshold=300)
    _append(store, spark, sf_dir)
    store.ingest_all()
    return store.wal.read().select("wal_seq", "session_id")


@query(f"""WITH {EVENTS}, n AS (SELECT (count(*) // 2) // 1000 * 1000 AS baked FROM e)
SELECT wal_seq, row_number() OVER (PARTITION BY (wal_seq - 1) // 1000 ORDER BY ts, agent_id, session_id, wal_seq) AS place FROM e, n WHERE wal_seq <= baked""")
def store_baked_file_order(spark, sf_dir):
    """Where each record really stands in its baked file."""
    store = half_baked(spark, sf_dir)
    paths = [r[0] for r in store.manifest.blocks().where("block_type = 'BAKED'").select("block_path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "wal_seq long, place long")
    return spark.read.schema(RECORDS).parquet(*paths).select("wal_seq", (F.col("_metadata.row_index") + 1).alias("place"))


@query("SELECT count(*) AS n_records, CASE WHEN count(*) % 1000 = 0 THEN 0 ELSE 1 END::BIGINT AS fresh_folders, count(*) // 1000 AS baked_blocks, true AS all_zstd FROM events")
def store_vacuum(spark, sf_dir):
    """Fresh folders go once all of their blocks are baked; no record does."""
    store = _open(spark)
    _append(store, spark, sf_dir)
    store.ingest_all()
    store.compact()
    store.vacuum()
    baked = store.manifest.blocks().where("block_type = 'BAKED'")
    folders = [store.root + "/wal/" + n for n in files.names(spark, store.root + "/wal")]
    written = [n for f in folders for n in files.names(spark, f) if n.endswith(".parquet")]
    left = len(files.names(spark, f"{store.root}/fresh"))
    counted = _live(store).agg(F.count(F.lit(1)).alias("n_records"))
    return counted.withColumns(
        {"fresh_folders": F.lit(left).cast("long"), "baked_blocks": F.lit(baked.count()).cast("long"), "all_zstd": F.lit(bool(written) and all(".zstd." in n for n in written))}
    )


@query(f"WITH {EVENTS} SELECT agent_id, session_id, ts, log AS raw_conversation_log FROM e")
def stream_available_now(spark, sf_dir):
    """A stream over a folder of request files, run to its end; its first batch is then given once more, and is not stored again."""
    store = _open(spark)
    folder = f"{store.root}-requests"
    requests = event_wal(spark, sf_dir).select(*REQUEST)
    requests.repartition(4).write.parquet(folder)
    ingest_stream(store, folder_stream(spark, folder, files_per_batch=2), f"{store.root}-checkpoint").awaitTermination()
    store_batch(store, requests, 0, "default")
    store.compact()
    return _live(store).select("agent_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "raw_conversation_log")


@query(f"WITH {EVENTS} SELECT wal_seq, agent_id FROM e")
def store_two_writers(spark, sf_dir):
    """A writer that has read an older version gets a conflict, and leaves the other's rows as they are."""
    first = _open(spark)
    second = LogStore(spark, first.root, first.embedder, first.config)
    old = second.manifest.cursors()
    second.manifest.cursors = lambda: old
    _append(first, spark, sf_dir)
    try:
        second.store_one("loser", "loser", "loser")
    except Conflict:
        return first.wal.read().select("wal_seq", "agent_id")
    raise AssertionError("both writers committed")


@query("SELECT true AS ingested, false AS moved_by_nothing, true AS compacted")
def store_last_runs(spark, sf_dir):
    """The time of the last ingestion moves with a batch that has records, and only then."""
    store = _open(spark, max_records_per_block=1)
    store.store_one("a", "s", "log")
    store.ingest()
    before = store.manifest.cursors().last_ingestion_run
    store.ingest()
    moved = store.manifest.cursors().last_ingestion_run != before
    store.compact()
    row = (before is not None, moved, store.manifest.cursors().last_compaction_run is not None)
    return spark.createDataFrame([row], "ingested boolean, moved_by_nothing boolean, compacted boolean")


@query("""SELECT path, code, CASE WHEN code = 200 THEN (SELECT count(*) FROM events) END AS shown
FROM (VALUES ('/statusz', 200), ('/statusz?all', 200), ('/', 404), ('/statuszz', 404)) t(path, code)""")
def store_status_page(spark, sf_dir):
    store, rows = half_baked(spark, sf_dir), []
    for path in ("/statusz", "/statusz?all", "/", "/statuszz"):
        code, page = respond(store, path)
        found = re.search(r"Records ingested: (\d+)", page)
        rows.append((path, code, int(found.group(1)) if found else None))
    return spark.createDataFrame(rows, "path string, code int, shown long")


@query("SELECT * FROM (VALUES ('', 'x', false), ('me', '', false), ('me', 'x', true)) t(caller, query, valid)")
def query_validation(spark, sf_dir):
    rows = []
    for caller, text in (("", "x"), ("me", ""), ("me", "x")):
        try:
            LogQuery(caller, text).check()
            rows.append((caller, text, True))
        except ValueError:
            rows.append((caller, text, False))
    return spark.createDataFrame(rows, "caller string, query string, valid boolean")


_OTHERS = "SELECT e.vec_id{more} FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE e.vec_id % 3 <> {left} AND list_inner_product(e.embedding::DOUBLE[], q::DOUBLE[]) >= 0.2"


@query(_OTHERS.format(more=", true AS refused", left=1))
def dimension_mismatch(spark, sf_dir):
    """Vectors of another length match nothing, and are an error if the store is strict."""
    rows = vector_records(spark, sf_dir).withColumn("embedding", F.expr("CASE WHEN wal_seq % 3 = 1 THEN slice(embedding, 1, size(embedding) - 1) ELSE embedding END"))
    vector, refused = _vector_zero(spark, sf_dir), False
    try:
        matching(rows, vector, 0.2).count()
    except Exception as error:  # noqa: BLE001 - the message tells whether it is the one
        if "another length" not in str(error):
            raise
        refused = True
    return matching(rows, vector, 0.2, strict=False).select(F.col("wal_seq").alias("vec_id"), F.lit(refused).alias("refused"))


@query(_OTHERS.format(more="", left=2))
def empty_embeddings(spark, sf_dir):
    """Records without an embedding match nothing, whatever the threshold."""
    rows = vector_records(spark, sf_dir).withColumn("embedding", F.expr("CASE WHEN wal_seq % 3 = 2 THEN slice(embedding, 1, 0) ELSE embedding END"))
    return matching(rows, _vector_zero(spark, sf_dir), 0.2).select(F.col("wal_seq").alias("vec_id"))


class _Parts(summarize.Summarizer):
    """The parts themselves, so that they can be held against the text."""

    def summaries(self, log: str) -> list[str]:
        return summarize.parts(log)


@query(f"SELECT doc_id, md5(coalesce(text, '')) AS text_md5, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= {summarize.SHORT_WORDS} AS one_part FROM documents WHERE text IS NOT NULL")
def summary_parts_cover(spark, sf_dir):
    """One row for each part of a log; the parts side by side are the log."""
    found = summarize.exploded(_table(spark, sf_dir, "documents").select("doc_id", "text"), _Parts(), "text")
    parts = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "summary"))).alias("p"))
    return parts.select("doc_id", F.md5(F.array_join("p.summary", "")).alias("text_md5"), (F.size("p") == 1).alias("one_part"))


class _Flaky:
    """A service that is away at every other call and answers with the conversation's text in capitals."""

    def __init__(self):
        self.calls = 0

    def __call__(self, request: str) -> str:
        self.calls += 1
        if self.calls % 2:
            raise summarize.SummaryError("UNAVAILABLE", "away")
        prompt = json.loads(request)["contents"][0]["parts"][0]["text"]
        payload = json.dumps([prompt.removeprefix(summarize.INSTRUCTIONS).upper()])
        return json.dumps({"candidates": [{"content": {"parts": [{"text": f"```json\n{payload}\n```"}]}}]})


@query("SELECT event_id, upper(event_type) AS summary FROM events")
def remote_summaries(spark, sf_dir):
    """Requests, retries, answers and their parsing, with a transport in place of the network."""
    service = summarize.RemoteSummarizer(_Flaky(), sleep=lambda seconds: None)
    found = _table(spark, sf_dir, "events").select("event_id", service.column(F.col("event_type")).alias("s"))
    return found.select("event_id", F.element_at("s.summaries", 1).alias("summary"))


@query("SELECT event_id, CASE WHEN length(props) > 7 THEN substr(props, 1, 7) || '...' ELSE props END AS short, 'event=log type=' || event_type || ' user=' || user_id AS line FROM events")
def log_lines(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", scalar.truncated(F.col("props"), 7).alias("short"), scalar.event_text("log", type=F.col("event_type"), user=F.col("user_id")).alias("line"))
