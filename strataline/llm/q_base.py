"""The columns of op1, op3, op5, op6, op8 and op9 that SQL can express, as queries of their own; each takes its rows from the whole query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import q_licenses, q_lm, q_media, q_mixing, q_quality, q_secrets


def _columns(query, *names: str):
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 by document and source, and whether what a source's documents took comes within 2 % of its target."""
    rows = q_mixing.op8_source_mixing(spark, sf_dir)
    near = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest"))
    near = near.select(F.col("source_size").alias("s"), F.col("target").alias("t"), (F.abs(F.col("taken") - F.col("target")) <= F.greatest(0.02 * F.col("target"), F.col("largest"))).alias("near"))
    joined = rows.join(near, (F.col("source_size") == F.col("s")) & (F.col("target") == F.col("t")))
    return joined.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "near", (F.col("taken") <= 3 * F.col("size")).alias("within"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q_lm.op6_lm_scores(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {
    "secret_base": _columns(q_secrets.op1_secret_scan, "doc_id", "n_assign", "n_access", "n_hex"),
    "quality_base": _columns(q_quality.op3_quality_rules, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "media_payload": _columns(q_media.op5_media_columns, "doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "lm_base": lm_base,
    "mixing_sizes": mixing_sizes,
    "license_base": _columns(q_licenses.op9_license_scan, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

SQL = {
    "secret_base": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(x, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex FROM t
""",
    "quality_base": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, {_WORDS.format(x="x")} AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, (len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws)) AS base_failed
FROM w LEFT JOIN r USING (doc_id)
""",
    "media_payload": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), n AS (SELECT doc_id, x, strlen(x) AS n FROM t),
p AS (SELECT *, CASE WHEN n = 0 THEN 64 ELSE (n + 63) // 64 * 64 END AS m FROM n)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(encode(x) || CASE WHEN m = n THEN ''::BLOB ELSE unhex(repeat('00', (m - n)::INT)) END) AS payload_sha256 FROM p
""",
    "lm_base": rf"""
WITH RECURSIVE crc AS (SELECT range AS k, 0 AS step, range AS c FROM range(256) UNION ALL SELECT k, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE step < 8),
tab AS (SELECT list(c ORDER BY k) AS tab FROM crc WHERE step = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents),
walk AS (SELECT doc_id, s, 0 AS k, 4294967295 AS c FROM ids UNION ALL SELECT doc_id, s, k + 1, xor(tab[(xor(c, ascii(s[k + 1])::BIGINT) & 255) + 1], c >> 8) FROM walk, tab WHERE k < length(s)),
held AS (SELECT doc_id, coalesce(xor(c, 4294967295) % 7 = 2, false) AS held_out FROM walk WHERE k = length(s)),
tok AS (SELECT doc_id, unnest(list_append({_WORDS.format(x=_LOWER)}, ' ')) AS w FROM documents),
cnt AS (SELECT w, count(*) AS c FROM tok JOIN held USING (doc_id) WHERE NOT held_out GROUP BY w),
tot AS (SELECT sum(c) AS n, count(*) AS v FROM cnt)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM tok JOIN held USING (doc_id) LEFT JOIN cnt USING (w), tot GROUP BY doc_id
""",
    "mixing_sizes": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS.format(x="coalesce(text, '')")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ([1, 2, 3])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
level AS (SELECT 0 AS k, (SELECT sum(n) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS share
  UNION ALL SELECT k + 1, ((SELECT sum(n) FROM s) - 3 * coalesce((SELECT sum(n) FROM s WHERE share * w > 3 * n), 0)) / (SELECT sum(w) FROM s WHERE share * w <= 3 * n) FROM level WHERE k < 60 AND (SELECT count(*) FROM s WHERE share * w <= 3 * n) > 0),
last AS (SELECT share FROM level ORDER BY k DESC LIMIT 1)
SELECT doc_id, size, n AS source_size, round(least(share * w, 3.0 * n), 3) AS target, true AS near, true AS within FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, last
""",
    "license_base": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) AS v(phrase, label)),
h AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN p ON ws[i] = phrase[1] AND ws[i:i + len(phrase) - 1] = phrase),
a AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN a USING (doc_id)
""",
}
