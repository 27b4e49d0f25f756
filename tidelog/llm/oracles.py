"""DuckDB SQL that gives the same rows as the queries, built from other parts than they are."""

from __future__ import annotations

from tidelog.llm import linededup, quality, sharding

#: A table of CRC-32 remainders by rule: eight steps of the reflected polynomial 0xEDB88320.
_CRC = """
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)::BIGINT[]),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(b)))
"""

OP1 = f"""
WITH RECURSIVE {_CRC},
texts AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
      lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM texts, crc_table),
start AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS k FROM documents),
jumps AS (
  SELECT doc_id, k, -1::BIGINT AS cur, 0::BIGINT AS next FROM start
  UNION ALL
  SELECT doc_id, k2, next, floor((next + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, next, (k * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jumps WHERE next <= 40)),
shards AS (SELECT doc_id, max(CASE WHEN cur < 40 THEN cur END)::INTEGER AS shard, max(cur)::INTEGER AS grown_shard FROM jumps GROUP BY doc_id),
placed AS (
  SELECT s.*, shard, grown_shard,
    ((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 9, 8))::BIGINT + text_crc32 + size) % 64) AS bucket
  FROM sums s JOIN shards h ON s.doc_id IS NOT DISTINCT FROM h.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

OP3 = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
placed AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, text ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
    count(*) OVER (PARTITION BY doc_id, text) AS n FROM lines),
plain AS (SELECT *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS u FROM placed),
ranked AS (
  SELECT *, u <> '' AND row_number() OVER (PARTITION BY u ORDER BY doc_id NULLS LAST, place) > 1 AS gone FROM plain),
texts AS (SELECT row_number() OVER () AS k, doc_id, text FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
pieces AS (
  SELECT k, regexp_split_to_array(lower(text), '[.!?]+(?:[ \\t-\\r]+|$)|\\n+') AS p FROM texts),
sentences AS (
  SELECT k, i, list_filter(regexp_split_to_array(piece, '\\s+'), lambda x: x <> '') AS words FROM (
    SELECT k, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM pieces)),
counted AS (
  SELECT k, i, words, (sum(len(words)) OVER (PARTITION BY k ORDER BY i))::BIGINT AS upto FROM sentences WHERE len(words) > 0),
flat AS (SELECT k, flatten(list(words ORDER BY i)) AS words FROM counted GROUP BY k),
found AS (
  SELECT f.k, array_to_string(f.words[a.upto - len(a.words) + 1 : b.upto], ' ') AS passage
  FROM (SELECT *, upto - len(words) + {linededup.PASSAGE} AS wanted FROM counted) a ASOF JOIN counted b ON a.k = b.k AND a.wanted <= b.upto
  JOIN flat f ON f.k = a.k),
shared AS (SELECT DISTINCT k FROM found WHERE passage IN (SELECT passage FROM found GROUP BY passage HAVING count(DISTINCT k) > 1))
SELECT r.doc_id, CASE WHEN r.text = '' THEN 0 ELSE max(n) END AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(s || ':' || (s + length(line)), ',' ORDER BY place) FILTER (WHERE gone), '') AS removed,
  sha256(coalesce(string_agg(CASE WHEN place + 1 < n THEN line || chr(10) ELSE line END, '' ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256,
  bool_or(t.k IN (SELECT k FROM shared)) AS has_passage
FROM ranked r JOIN texts t ON t.doc_id IS NOT DISTINCT FROM r.doc_id AND t.text = r.text GROUP BY r.doc_id, r.text
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op6() -> str:
    values = {
        "symbols": "floor(1000 * n_symbols / greatest(word_chars, 1))",
        "length": "floor(10 * word_chars / greatest(n_words, 1))",
        "lines": "floor(1000 * n_dup_lines / greatest(n_lines, 1))",
        "repeats": "floor(1000 * n_repeat_words / greatest(n_words, 1))",
    } | {c: f"({c} >> greatest(length(bin({c})) - 4, 0)) << greatest(length(bin({c})) - 4, 0)" for c in quality.SIZES}
    values = "\n  UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, ({v})::BIGINT AS v FROM counts WHERE NOT base_failed" for m, v in values.items())
    least = f"""CASE metric WHEN 'symbols' THEN floor(10000 / greatest({quality.SYMBOL_WORDS} * word_length, 1)) WHEN 'length' THEN floor(word_length / 2)
      WHEN 'lines' THEN floor({1000 * quality.LINES} / greatest(lines, 1)) ELSE floor({1000 * quality.WINDOWS} / greatest(words, 1)) END"""
    fence = lambda keys: f"""  SELECT {keys} metric, n, q1 - away AS low, q3 + away AS high FROM (
    SELECT {keys} metric, n, q1, q3, greatest({quality.FENCE} * (q3 - q1), {least}) AS away FROM (
      SELECT *, max(q2) FILTER (WHERE metric = 'length') OVER g AS word_length, max(q2) FILTER (WHERE metric = 'n_lines') OVER g AS lines,
        max(q2) FILTER (WHERE metric = 'n_words') OVER g AS words FROM (
          SELECT {keys} metric, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS q2, quantile_disc(v, 0.75) AS q3 FROM vals GROUP BY ALL)
      WINDOW g AS ({f'PARTITION BY {keys[:-1]}' if keys else ''}))) WHERE metric NOT IN ('n_lines', 'n_words')"""  # noqa: E731
    mixed = lambda own, wider, side: f"floor(({own}.n * {own}.{side} + {quality.LEAN} * {wider}.{side}) / ({own}.n + {quality.LEAN})) AS {side}"
    return f"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM words),
grams AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
  FROM lines d LEFT JOIN covered c ON d.doc_id = c.doc_id),
vals AS ({values}),
own AS ({fence("lang, source,")}),
by_lang AS ({fence("lang,")}),
wide AS ({fence("")}),
in_lang AS (SELECT g.lang, g.metric, {mixed('g', 'a', 'low')}, {mixed('g', 'a', 'high')} FROM by_lang g JOIN wide a ON a.metric = g.metric),
in_group AS (
  SELECT o.lang, o.source, o.metric, {mixed('o', 'g', 'low')}, {mixed('o', 'g', 'high')}
  FROM own o JOIN in_lang g ON g.metric = o.metric AND g.lang IS NOT DISTINCT FROM o.lang),
judged AS (
  SELECT c.doc_id, v.metric, g.low, g.high, v.v FROM counts c JOIN vals v ON c.doc_id = v.doc_id
  JOIN in_group g ON g.metric = v.metric AND g.lang IS NOT DISTINCT FROM c.lang AND g.source IS NOT DISTINCT FROM c.source),
bad AS (
  SELECT doc_id, string_agg(metric, ',' ORDER BY list_position(['symbols', 'length', 'lines', 'repeats'], metric)) AS failed
  FROM judged WHERE v > high OR (metric = 'length' AND v < low) GROUP BY doc_id)
SELECT c.doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND b.failed IS NULL AS kept, coalesce(b.failed, '') AS failed
FROM counts c LEFT JOIN bad b ON c.doc_id = b.doc_id
"""


OP6 = _op6()
ORACLES = {"op1_jump_sharding": OP1, "op3_line_dedup": OP3, "op4_exact_top_k": OP4, "op6_adaptive_quality": OP6}
