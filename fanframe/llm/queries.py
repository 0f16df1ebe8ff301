"""The queries of this subpackage by name: (spark, sf_dir) -> DataFrame; and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fanframe.llm import bpe, chat, maxent, media, minhash, packing, pii, quality, sharding, substrings
from fanframe.llm.common import documents

#: The conversation that the formatting query adds.
ADVERSE = r"\### Assistant: </turn> ok"


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(documents(spark, sf_dir))


def op3_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest_quality(documents(spark, sf_dir))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.store_documents(documents(spark, sf_dir)))


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", ADVERSE), (-7, 1, "assistant", ADVERSE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render_turns(table.unionByName(more)))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_substrings(documents(spark, sf_dir))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The raw turn if it has no control string, else each control string after a backslash.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{adverse}' UNION ALL SELECT -7, 1, 'assistant', '{adverse}'
), rendered AS (
  SELECT *, '### ' || regexp_replace(role, '(\\|### |: |</turn>)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS r FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, r)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, r) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r))::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
""".replace("{adverse}", ADVERSE)


#: Exact multiset overlaps of all texts that share a shingle, then the components of the links.
NEAR_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, text, doc_id FROM (SELECT coalesce(text, '') AS text, min(doc_id) AS doc_id FROM documents GROUP BY 1)
), words AS (
  SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), shingles AS (
  SELECT id, array_to_string(w[k : k + 4], ' ') AS shingle, count(*) AS n
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM words) GROUP BY ALL
), sizes AS (
  SELECT id, sum(n) AS size FROM shingles GROUP BY id
), pairs AS (
  SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS common FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE common >= 0.8 * (s.size + t.size - common) - 1e-9
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT id, id AS other FROM texts UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.other
), classes AS (
  SELECT r.id, min(t.doc_id) AS class_id FROM reached r JOIN texts t ON t.id = r.other GROUP BY r.id
)
SELECT d.doc_id::BIGINT AS doc_id, c.class_id::BIGINT AS class_id
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.id = t.id
"""

#: Every 50-byte string of every text with the smallest doc_id that has it, then the runs of bytes that those of earlier documents cover.
SUBSTRINGS_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, 9223372036854775807) AS place, encode(coalesce(text, '')) AS t FROM documents
), starts_of AS (
  SELECT id, place, t, unnest(range(1, octet_length(t) - 48)) AS k FROM texts
), strings AS (
  SELECT id, place, k, t[k : k + 49] AS s FROM starts_of
), least_of AS (
  SELECT s, min(place) AS earliest FROM strings GROUP BY s HAVING min(place) < max(place)
), found AS (
  SELECT id, k FROM strings JOIN least_of USING (s) WHERE earliest < place
), numbered AS (
  SELECT id, k, sum(opens) OVER (PARTITION BY id ORDER BY k) AS run
  FROM (SELECT id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY id ORDER BY k) + 50 THEN 0 ELSE 1 END AS opens FROM found)
), runs AS (
  SELECT id, min(k) AS a, max(k) + 50 AS z FROM numbered GROUP BY id, run
), parts AS (
  SELECT id, a, z, coalesce(lag(z) OVER (PARTITION BY id ORDER BY a), 1) AS open FROM runs
), cut AS (
  SELECT id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(CASE WHEN open < a THEN hex(t[open : a - 1]) ELSE '' END, '' ORDER BY a) AS head
  FROM parts JOIN texts USING (id) GROUP BY id
)
SELECT doc_id::BIGINT AS doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN coalesce(last, 1) <= octet_length(t) THEN hex(t[coalesce(last, 1) : octet_length(t)]) ELSE '' END)) AS kept_sha256
FROM texts LEFT JOIN cut USING (id)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express, each on one line."""
    sql = {"op1_bagminhash": NEAR_SQL, "op7_chat_round_trip": CHAT_SQL, "op8_suffix_array": SUBSTRINGS_SQL}
    return {name: " ".join(q.split("\n")) for name, q in sql.items()}
