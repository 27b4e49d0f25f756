"""The store's operators as queries over the driver's tables, each with DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.config import LogConfig
from tidelog.functions import bloom, scalar, summarize
from tidelog.functions.embed import ByteHistogramEmbedder
from tidelog.operators import blocks as op
from tidelog.operators.filters import LogQuery, candidate_blocks, overlaps, record_filter, validated
from tidelog.operators.scoring import matching, matching_many
from tidelog.plans.query import result_status
from tidelog.plans.status import active_records, baked_blocks, total_ingested
from tidelog.sources.schemas import ACTIVE, BAKED, FRESH, READY, SEALED

SIZE = 1000
ASK = "Did the build pass?"
T0 = datetime(2024, 1, 10, tzinfo=timezone.utc)
T1 = datetime(2024, 1, 20, tzinfo=timezone.utc)
HIT_THRESHOLD = 5000.0

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the driver's tables in the store's shape


def event_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a write-ahead table; numbers start at 1."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("wal_seq"),
        F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent_id"),
        F.concat(F.lit("s_"), F.col("event_type")).alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("conversation_log"),
        F.lit(None).cast("string").alias("summary"),
    )


def conversation_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("wal_seq"),
        F.col("role").alias("agent_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("session_id"),
        F.timestamp_micros(F.lit(1704067200000000) + (F.col("conv_id") * 3600 + F.col("turn")) * 1_000_000).alias("ts"),
        F.col("text").alias("conversation_log"),
        F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.substring_index("text", "\n", 1)).alias("summary"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal = event_wal(spark, sf_dir)
    return op.to_records(wal, ByteHistogramEmbedder(), op.block_offset(F.col("wal_seq"), 0, 0, SIZE))


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return v.select(
        F.floor(F.col("vec_id") / SIZE).alias("block_id"),
        F.col("vec_id").alias("wal_seq"),
        F.concat(F.lit("agent_"), F.col("label").cast("string")).alias("agent_id"),
        F.concat(F.lit("vec_"), (F.col("vec_id") % 10).cast("string")).alias("session_id"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("vec_id") * 1_000_000).alias("ts"),
        F.col("vec_id").cast("string").alias("raw_conversation_log"),
        "embedding",
    )


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of the events' blocks: full ones baked, every fourth still sealed, the last one active if not full."""
    records = event_records(spark, sf_dir)
    bits, hashes = bloom.size_for(SIZE)
    stats = op.block_stats(records).join(op.block_blooms(records, bits, hashes), "block_id")
    full = F.col("record_count") >= SIZE
    sealed = full & (F.col("block_id") % 4 == 3)
    return stats.withColumn("block_type", F.when(full & ~sealed, BAKED).otherwise(FRESH)).withColumn(
        "state", F.when(sealed, SEALED).when(full, READY).otherwise(ACTIVE)
    )


EVENTS = """e AS (SELECT event_id + 1 AS wal_seq, 'agent_' || user_id AS agent_id, 's_' || event_type AS session_id, ts,
  concat_ws(' ', event_type, props) AS log, (event_id // 1000) AS block_id FROM events)"""
STATES = f"""WITH {EVENTS}, b AS (SELECT block_id, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts FROM e GROUP BY 1),
s AS (SELECT *, CASE WHEN n >= 1000 AND block_id % 4 <> 3 THEN 'BAKED' ELSE 'FRESH' END AS block_type,
  CASE WHEN n >= 1000 AND block_id % 4 = 3 THEN 'SEALED' WHEN n >= 1000 THEN 'READY' ELSE 'ACTIVE' END AS state FROM b)"""
#: UTF-8 bytes of a text by their value modulo 8, as a list of eight counts.
HISTOGRAM = "list_transform(range(8), lambda k: length(regexp_replace(regexp_replace(hex(encode({t})), '(.)(.)', '\\2', 'g'), '[^' || substr('01234567', k + 1, 1) || substr('89ABCDEF', k + 1, 1) || ']', '', 'g')))"


def _filtered(spark, sf_dir, **filters) -> DataFrame:
    records = event_wal(spark, sf_dir).where(record_filter(LogQuery("me", ASK, **filters)))
    return records.select("agent_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.col("conversation_log").alias("raw_conversation_log"))


_OUT = f"WITH {EVENTS} SELECT agent_id, session_id, ts AS timestamp, log AS raw_conversation_log FROM e WHERE "


@query(_OUT + "agent_id = 'agent_7'")
def filter_agent(spark, sf_dir):
    return _filtered(spark, sf_dir, agent_id="agent_7")


@query(_OUT + "session_id = 's_error'")
def filter_session(spark, sf_dir):
    return _filtered(spark, sf_dir, session_id="s_error")


@query(_OUT + "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def filter_time_inclusive(spark, sf_dir):
    return _filtered(spark, sf_dir, start_time=T0, end_time=T1)


@query(_OUT + "ts = (SELECT min(ts) FROM events)")
def filter_point_time(spark, sf_dir):
    first = event_wal(spark, sf_dir).agg(F.min("ts")).first()[0]
    return _filtered(spark, sf_dir, start_time=first, end_time=first)


@query(_OUT + "agent_id = 'agent_7' AND session_id = 's_click' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'")
def filter_all(spark, sf_dir):
    return _filtered(spark, sf_dir, agent_id="agent_7", session_id="s_click", start_time=T0, end_time=T1)


@query(_OUT + "false")
def filter_empty_range(spark, sf_dir):
    return _filtered(spark, sf_dir, start_time=T1, end_time=T0)


@query(_OUT + "agent_id = ''")
def filter_present_but_empty(spark, sf_dir):
    return _filtered(spark, sf_dir, agent_id="")


_VECTOR = "SELECT e.vec_id FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE list_inner_product(e.embedding::DOUBLE[], q::DOUBLE[]) >= 0.2"


def _vector_zero(spark, sf_dir) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query(_VECTOR)
def semantic_threshold(spark, sf_dir):
    hits = matching(vector_records(spark, sf_dir), _vector_zero(spark, sf_dir), 0.2)
    return hits.select(F.col("wal_seq").alias("vec_id"))


@query(_VECTOR + " AND e.label = 0 AND e.vec_id <= 300")
def semantic_threshold_filtered(spark, sf_dir):
    end = datetime(2024, 1, 1, 0, 5, tzinfo=timezone.utc)
    rows = vector_records(spark, sf_dir).where(record_filter(LogQuery("me", ASK, agent_id="agent_0", end_time=end)))
    return matching(rows, _vector_zero(spark, sf_dir), 0.2).select(F.col("wal_seq").alias("vec_id"))


@query("""SELECT 'q' || a.vec_id AS query_id, b.vec_id FROM embeddings a, embeddings b
WHERE a.vec_id % 20 = 0 AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35""")
def semantic_many_queries(spark, sf_dir):
    asked = _table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select("vec_id", "embedding")
    hits = matching_many(vector_records(spark, sf_dir), ((f"q{r[0]}", list(r[1])) for r in asked.toLocalIterator()), 0.35)
    return hits.select("query_id", F.col("wal_seq").alias("vec_id"))


@query(f"""SELECT conv_id, turn FROM conversations
WHERE list_inner_product({HISTOGRAM.format(t='text')}::DOUBLE[], [5, 3, 1, 2, 5, 2, 0, 1]::DOUBLE[]) >= {HIT_THRESHOLD}""")
def semantic_text_query(spark, sf_dir):
    embedder = ByteHistogramEmbedder()
    rows = conversation_wal(spark, sf_dir).withColumn("embedding", embedder.column(F.col("conversation_log")))
    hits = matching(rows, embedder.vector(spark, ASK), HIT_THRESHOLD)
    return hits.select(F.floor(F.col("wal_seq") / 1000).alias("conv_id"), (F.col("wal_seq") % 1000).alias("turn"))


@query(f"SELECT conv_id, turn, array_to_string({HISTOGRAM.format(t='text')}, ',') AS embedding FROM conversations")
def embed_byte_histogram(spark, sf_dir):
    counts = F.transform(scalar.byte_histogram(F.col("text")), lambda x: x.cast("int").cast("string"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(counts, ",").alias("embedding"))


@query(f"""SELECT conv_id, turn, unnest(range(8)) AS i, unnest(list_transform(h, lambda x: CASE WHEN n = 0 THEN 0 ELSE round(1e6 * x / sqrt(n))::BIGINT END)) AS v
FROM (SELECT *, list_sum(list_transform(h, lambda x: x * x)) AS n FROM (SELECT conv_id, turn, {HISTOGRAM.format(t='text')} AS h FROM conversations))""")
def embed_l2_normalised(spark, sf_dir):
    unit = scalar.normalised(scalar.byte_histogram(F.col("text")))
    parts = F.posexplode(F.transform(unit, lambda x: F.round(x * 1e6).cast("long"))).alias("i", "v")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", parts).withColumn("i", F.col("i").cast("long"))


@query("""SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 1 AND split_part(text, chr(10), 1) <> '' THEN split_part(text, chr(10), 1) ELSE text END) AS text_md5 FROM conversations""")
def embed_text_choice(spark, sf_dir):
    chosen = scalar.embedding_text(F.col("summary"), F.col("conversation_log"))
    return conversation_wal(spark, sf_dir).select(
        F.floor(F.col("wal_seq") / 1000).alias("conv_id"), (F.col("wal_seq") % 1000).alias("turn"), F.md5(chosen).alias("text_md5")
    )


_REQUESTS = """r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'agent_' || user_id END AS agent_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS session_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE props END AS log FROM events)"""


def _requests(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("agent_"), F.col("user_id").cast("string"))).alias("agent_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("session_id"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("props")).alias("conversation_log"),
        F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("ts"),
    )


@query(f"""WITH {_REQUESTS}, m AS (SELECT event_id, concat_ws(', ', CASE WHEN coalesce(agent_id, '') = '' THEN 'agent_id' END,
  CASE WHEN coalesce(session_id, '') = '' THEN 'session_id' END, CASE WHEN coalesce(log, '') = '' THEN 'conversation_log' END) AS m FROM r)
SELECT event_id, CASE WHEN m = '' THEN 'OK' ELSE 'INVALID_ARGUMENT' END AS status, CASE WHEN m = '' THEN '' ELSE 'missing: ' || m END AS error_message FROM m""")
def store_validation(spark, sf_dir):
    return validated(_requests(spark, sf_dir)).select("event_id", "status", "error_message")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2030-01-01' ELSE ts END AS ts FROM events")
def store_default_timestamp(spark, sf_dir):
    now = F.lit(datetime(2030, 1, 1, tzinfo=timezone.utc))
    return _requests(spark, sf_dir).select("event_id", scalar.or_now(F.col("ts"), now).cast("timestamp_ntz").alias("ts"))


@query(f"WITH {EVENTS} SELECT wal_seq, agent_id FROM e WHERE wal_seq > 300 ORDER BY wal_seq LIMIT 200")
def wal_read_batch(spark, sf_dir):
    return event_wal(spark, sf_dir).where((F.col("wal_seq") > 300) & (F.col("wal_seq") <= 500)).select("wal_seq", "agent_id")


@query(f"WITH {EVENTS} SELECT wal_seq FROM e WHERE wal_seq > (SELECT max(wal_seq) FROM e) - 250")
def wal_trim_keep_last(spark, sf_dir):
    wal = event_wal(spark, sf_dir)
    last = wal.agg(F.max("wal_seq")).first()[0]
    return wal.where(F.col("wal_seq") > op.keep_last(last + 1, 0, last, 250, 300)).select("wal_seq")


@query("SELECT count(*) AS wal_records FROM events")
def wal_record_count(spark, sf_dir):
    return event_wal(spark, sf_dir).agg(F.count(F.lit(1)).alias("wal_records"))


@query(f"WITH {EVENTS} SELECT wal_seq, block_id FROM e")
def block_assignment(spark, sf_dir):
    return event_wal(spark, sf_dir).select("wal_seq", op.block_offset(F.col("wal_seq"), 0, 0, SIZE).alias("block_id"))


@query(f"WITH {EVENTS} SELECT block_id, count(*) AS record_count, min(ts) AS min_ts, max(ts) AS max_ts FROM e GROUP BY 1")
def block_stats(spark, sf_dir):
    stats = op.block_stats(event_records(spark, sf_dir))
    return stats.withColumn("min_ts", F.col("min_ts").cast("timestamp_ntz")).withColumn("max_ts", F.col("max_ts").cast("timestamp_ntz"))


@query(f"WITH {EVENTS}, c AS (SELECT (wal_seq + 699) // 1000 AS block_id, count(*) + CASE WHEN (wal_seq + 699) // 1000 = 0 THEN 700 ELSE 0 END AS record_count FROM e GROUP BY 1) SELECT * FROM c")
def block_rotation_counts(spark, sf_dir):
    """An active block that already holds 700 records is filled first."""
    at = op.block_offset(F.col("wal_seq"), 0, 700, SIZE).alias("block_id")
    counts = event_wal(spark, sf_dir).groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("block_id", (F.col("n") + F.when(F.col("block_id") == 0, 700).otherwise(0)).alias("record_count"))


@query(STATES + " SELECT block_id, block_type, state FROM s")
def block_state_machine(spark, sf_dir):
    return event_blocks(spark, sf_dir).select("block_id", "block_type", "state")


@query(STATES + " SELECT block_id FROM s WHERE min_ts <= TIMESTAMP '2024-01-20' AND max_ts >= TIMESTAMP '2024-01-10'")
def prune_time_overlap(spark, sf_dir):
    return event_blocks(spark, sf_dir).where(overlaps(LogQuery("me", ASK, start_time=T0, end_time=T1))).select("block_id")


def _held(spark, sf_dir, column: str, value: str) -> DataFrame:
    """Candidate blocks that really hold the value: a bloom filter may keep more, never fewer."""
    q = LogQuery("me", ASK, **{column: value})
    found = candidate_blocks(event_blocks(spark, sf_dir), q, *bloom.size_for(SIZE)).select("block_id")
    exact = event_records(spark, sf_dir).where(F.col(column) == value).select("block_id").distinct()
    return exact.join(found, "block_id", "left_semi")


@query(f"WITH {EVENTS} SELECT DISTINCT block_id FROM e WHERE agent_id = 'agent_7'")
def prune_agent_exact(spark, sf_dir):
    return _held(spark, sf_dir, "agent_id", "agent_7")


@query(f"WITH {EVENTS} SELECT DISTINCT block_id FROM e WHERE session_id = 's_error'")
def prune_session_exact(spark, sf_dir):
    return _held(spark, sf_dir, "session_id", "s_error")


@query("SELECT 0::BIGINT AS misses, count(*) AS members FROM (SELECT DISTINCT event_id // 1000, user_id FROM events)")
def bloom_no_false_negative(spark, sf_dir):
    members = event_records(spark, sf_dir).select("block_id", "agent_id").distinct()
    held = members.join(event_blocks(spark, sf_dir).select("block_id", "agent_bloom"), "block_id")
    hit = bloom.may_contain(F.col("agent_bloom"), F.col("agent_id"), *bloom.size_for(SIZE))
    return held.agg(F.sum(F.when(hit, 0).otherwise(1)).alias("misses"), F.count(F.lit(1)).alias("members"))


_UNION = f"WITH {EVENTS}, h AS (SELECT *, {HISTOGRAM.format(t='log')} AS v FROM e) SELECT wal_seq, agent_id FROM h WHERE list_inner_product(v::DOUBLE[], [5, 3, 1, 2, 5, 2, 0, 1]::DOUBLE[]) >= 40"


@query(_UNION)
def query_fresh_union_baked(spark, sf_dir):
    """Baked, sealed and active blocks are searched alike, through the candidates of the manifest."""
    records = event_records(spark, sf_dir)
    found = candidate_blocks(event_blocks(spark, sf_dir), LogQuery("me", ASK), *bloom.size_for(SIZE))
    baked = records.join(found.where(F.col("block_type") == BAKED).select("block_id"), "block_id", "left_semi")
    fresh = records.join(found.where(F.col("block_type") == FRESH).select("block_id"), "block_id", "left_semi")
    hits = matching(baked.unionByName(fresh), [5.0, 3.0, 1.0, 2.0, 5.0, 2.0, 0.0, 1.0], 40.0)
    return hits.select("wal_seq", "agent_id")


@query(f"WITH {EVENTS} SELECT block_id, wal_seq, row_number() OVER (PARTITION BY block_id ORDER BY ts, agent_id, session_id, wal_seq) AS place FROM e")
def baked_sorted_positions(spark, sf_dir):
    order = Window.partitionBy("block_id").orderBy(*op.BAKED_ORDER)
    return op.baked_order(event_records(spark, sf_dir)).select("block_id", "wal_seq", F.row_number().over(order).cast("long").alias("place"))


@query(_UNION.replace("SELECT wal_seq, agent_id FROM h", "SELECT block_id, wal_seq, log AS raw_conversation_log FROM h"))
def payload_late_fetch(spark, sf_dir):
    """Keys and vectors first; the logs of the hits by a second scan."""
    records = event_records(spark, sf_dir)
    index = records.select("block_id", "wal_seq", "embedding")
    hits = matching(index, [5.0, 3.0, 1.0, 2.0, 5.0, 2.0, 0.0, 1.0], 40.0).select("block_id", "wal_seq")
    return hits.join(records.select("block_id", "wal_seq", "raw_conversation_log"), ["block_id", "wal_seq"])


@query(STATES + " SELECT coalesce(sum(n), 0)::BIGINT AS total_records FROM s WHERE state IN ('READY', 'SEALED', 'ACTIVE')")
def status_totals(spark, sf_dir):
    return total_ingested(event_blocks(spark, sf_dir))


@query(STATES + " SELECT block_id, n AS record_count FROM s WHERE state = 'READY'")
def status_baked_blocks(spark, sf_dir):
    return baked_blocks(event_blocks(spark, sf_dir))


@query(STATES + " SELECT coalesce(max(n), 0)::BIGINT AS fresh_records FROM s WHERE block_id = (SELECT max(block_id) FROM s WHERE state = 'ACTIVE')")
def status_active_fresh(spark, sf_dir):
    return active_records(event_blocks(spark, sf_dir))


@query("""SELECT event_type, list_sort(list(value))[floor((count(*) - 1) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor((count(*) - 1) * 0.9)::INT + 1] AS p90
FROM events GROUP BY 1""")
def latency_percentiles_lower_rank(spark, sf_dir):
    return op.lower_rank_percentiles(_table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9})


@query("SELECT event_id, 1704067200000000::BIGINT + event_id * 1000000 + (event_id * 1234567 % 1000000000) // 1000 AS micros FROM events")
def proto_timestamp_micros(spark, sf_dir):
    made = scalar.from_proto_time(F.lit(1704067200) + F.col("event_id"), F.col("event_id") * 1234567 % 1_000_000_000)
    return _table(spark, sf_dir, "events").select("event_id", scalar.to_micros(made).alias("micros"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000)::BIGINT || 's' END AS elapsed FROM events")
def elapsed_seconds(spark, sf_dir):
    then = F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp"))
    now = F.lit(datetime(2024, 2, 1, tzinfo=timezone.utc))
    return _table(spark, sf_dir, "events").select("event_id", scalar.elapsed(now, then).alias("elapsed"))


@query("""SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS plain_md5 FROM conversations""")
def strip_code_fence(spark, sf_dir):
    """Every text is fenced first, so that stripping must give back the trimmed text."""
    c = _table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit(" \n```json\n"), F.col("text"), F.lit("\n```\t"))
    return c.select("conv_id", "turn", F.md5(scalar.strip_code_fence(fenced)).alias("plain_md5"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN md5(text || chr(10) || 'x') END AS text_md5 FROM conversations")
def extract_candidate_text(spark, sf_dir):
    """Responses of several shapes, every fourth without a text."""
    c = _table(spark, sf_dir, "conversations")
    parts = F.to_json(F.array(F.struct(F.col("text")), F.struct(F.lit("x").alias("text"))))
    body = F.concat(F.lit('{"candidates":[3,{"content":7},{"content":{"parts":'), parts, F.lit("}}]}"))
    body = F.when(F.col("turn") % 4 == 3, '{"candidates":[{"content":{"parts":[{"text":5},8]}}]}').otherwise(body)
    return c.select("conv_id", "turn", F.md5(scalar.candidate_text(body)).alias("text_md5"))


_PAYLOADS = {1: "nonsense", 2: '{"a":1}', 3: "[]", 4: '["a",1]', 5: '["a"," "]', 6: '```json\n["a"]\n```'}


@query("""SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'malformed JSON' WHEN 2 THEN 'not an array' WHEN 3 THEN 'empty array'
  WHEN 4 THEN 'non-string entry' WHEN 5 THEN 'empty string' END AS error, CASE event_id % 7 WHEN 6 THEN 'a' WHEN 0 THEN event_type || '|' || props END AS summaries FROM events""")
def parse_summary_array(spark, sf_dir):
    payload = F.to_json(F.array(F.col("event_type"), F.concat(F.lit(" "), F.col("props"))))
    for k, text in _PAYLOADS.items():
        payload = F.when(F.col("event_id") % 7 == k, text).otherwise(payload)
    parsed = scalar.summary_payload(payload)
    return _table(spark, sf_dir, "events").select("event_id", parsed["error"].alias("error"), F.array_join(parsed["summaries"], "|").alias("summaries"))


@query("""SELECT event_id, '{"contents":[{"role":"user","parts":[{"text":"' || event_type || '"}]}],"generationConfig":{"temperature":0.1,"responseMimeType":"application/json"}}' AS body FROM events""")
def summary_request_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", scalar.request_body(F.col("event_type")).alias("body"))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= {summarize.SHORT_WORDS} AS one_part FROM documents")
def summary_split_policy(spark, sf_dir):
    """Logs of up to 200 words are one part."""

    @F.pandas_udf("int")
    def count(texts):
        return texts.map(lambda t: len(summarize.parts(t or "")))

    return _table(spark, sf_dir, "documents").select("doc_id", (count("text") == 1).alias("one_part"))


@query(f"WITH {EVENTS} SELECT block_id, count(*) AS record_count, min(ts) AS min_ts, max(ts) AS max_ts FROM e GROUP BY 1")
def store_life_blocks(spark, sf_dir):
    """The whole life of a store: appended in two halves, ingested in batches, compacted; one row for each live block."""
    from tidelog.engine import LogStore
    from tidelog.sources.manifest import live

    store = LogStore(spark, scratch(spark), ByteHistogramEmbedder(), LogConfig(max_records_per_block=SIZE, wal_read_batch=1_000_000))
    wal = event_wal(spark, sf_dir)
    ordered = wal.orderBy("wal_seq")
    middle = wal.count() // 2
    for half in (F.col("wal_seq") <= middle, F.col("wal_seq") > middle):
        store.store(ordered.where(half).select("agent_id", "session_id", "conversation_log", "ts", "summary"))
        store.ingest_all()
    store.compact()
    blocks = live(store.manifest.blocks())
    place = F.row_number().over(Window.orderBy("min_wal"))
    firsts = store.blocks.read(blocks, store.manifest.cursors()).groupBy("block_id").agg(F.min("wal_seq").alias("min_wal"))
    out = blocks.join(firsts, "block_id").withColumn("place", place)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select((F.col("place") - 1).cast("long").alias("block_id"), "record_count", ntz("min_ts"), ntz("max_ts"))


def scratch(spark: SparkSession) -> str:
    """A folder for a query's own store, among the shared ones if the session names them."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


_MATRIX = [(s, f, p, e, r) for s in (0, 4) for f in (0, 2, 4) for p in (0, 1) for e in (10.0, 60.0) for r in (0, 3) if f <= s]


@query(f"""SELECT scheduled, failed, pending, elapsed_ms, n_rows, CASE WHEN pending > 0 OR elapsed_ms > 50 THEN 'INCOMPLETE'
  WHEN scheduled > 0 AND failed = scheduled AND n_rows = 0 THEN 'INTERNAL_ERROR' ELSE 'COMPLETE' END AS status
FROM (VALUES {', '.join(f'({s}, {f}, {p}, {e}::DOUBLE, {r})' for s, f, p, e, r in _MATRIX)}) t(scheduled, failed, pending, elapsed_ms, n_rows)""")
def query_result_status(spark, sf_dir):
    rows = [(*m, result_status(m[0], m[1], m[2], m[3], 50.0, m[4])) for m in _MATRIX]
    return spark.createDataFrame(rows, "scheduled int, failed int, pending int, elapsed_ms double, n_rows int, status string")
