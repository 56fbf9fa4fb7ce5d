"""Registered queries of the llm operators: name -> (query, oracle SQL)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import (
    bpe_tree,
    conversation_repair,
    decontaminate,
    embed_dedup,
    html_extract,
    mil_quality,
    quality_rules,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
    whitening,
)

#: Rules of the registered URL query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT s.page_id, s.host, s.path, rhost || rpath AS rule, length(rhost || rpath) * 1000 + length(rhost) AS rank, verdict FROM s LEFT JOIN r
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, arg_max(rule, rank) AS rule, coalesce(arg_max(verdict, rank), 'allow') AS verdict
FROM f GROUP BY page_id, host, path
"""


#: Conversation repair as a fold over each conversation's rows: for each state
#: (0 nothing written, 1 after s, 2 after u, 3 after a) the cheapest letters.  A
#: state's value is cost, letters and text; cost 1000000000 stands for none.
OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS rid,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), bits AS (
  SELECT DISTINCT k, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc FROM raw
), coded AS (
  SELECT raw.*, xor(crc, 4294967295::BIGINT) % 20 AS c FROM raw JOIN bits USING (k)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy, rid FROM coded WHERE c > 0
), placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS again,
         lag(role[1]) OVER w AS before FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), rid, copy)
), faults AS (
  SELECT *, role[1] AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed
), fold AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s1, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s2, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, d0, list_sort([d1, k1])[1], list_sort([d2, u0, u1, u3, r0, r1, r3])[1], list_sort([d3, a2, r2])[1]
  FROM (SELECT *,
      CASE WHEN gone OR x <> 's' THEN no ELSE {'c': s0.c + w, 'a': s0.a || 'K', 't': s0.t || own} END AS k1,
      CASE WHEN gone OR x <> 'u' THEN no ELSE {'c': s0.c + w, 'a': s0.a || 'K', 't': s0.t || own} END AS u0,
      CASE WHEN gone OR x <> 'u' THEN no ELSE {'c': s1.c + w, 'a': s1.a || 'K', 't': s1.t || own} END AS u1,
      CASE WHEN gone OR x <> 'u' THEN no ELSE {'c': i3.c + w, 'a': i3.a || 'K', 't': i3.t || own} END AS u3,
      CASE WHEN gone OR x <> 'a' THEN no ELSE {'c': i2.c + w, 'a': i2.a || 'K', 't': i2.t || own} END AS a2,
      CASE WHEN gone THEN no ELSE {'c': s0.c + w + 2, 'a': s0.a || 'R', 't': s0.t || chr(10) || 'user:' || text} END AS r0,
      CASE WHEN gone THEN no ELSE {'c': s1.c + w + 2, 'a': s1.a || 'R', 't': s1.t || chr(10) || 'user:' || text} END AS r1,
      CASE WHEN gone THEN no ELSE {'c': i3.c + w + 2, 'a': i3.a || 'R', 't': i3.t || chr(10) || 'user:' || text} END AS r3,
      CASE WHEN gone THEN no ELSE {'c': i2.c + w + 2, 'a': i2.a || 'R', 't': i2.t || chr(10) || 'assistant:' || text} END AS r2,
      {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} AS d0, {'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t} AS d1,
      {'c': i2.c + 3, 'a': i2.a || 'D', 't': i2.t} AS d2, {'c': i3.c + 3, 'a': i3.a || 'D', 't': i3.t} AS d3
    FROM (SELECT *, list_sort([s3, {'c': i2.c + 2, 'a': i2.a || 'I', 't': i2.t || chr(10) || 'assistant:'}])[1] AS i3
      FROM (SELECT f.conv_id, f.i, role, text, x, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS w, chr(10) || role || ':' || text AS own, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS no, s0, s1, s3,
          list_sort([s2, {'c': s0.c + 2, 'a': s0.a || 'I', 't': s0.t || chr(10) || 'user:'}, {'c': s1.c + 2, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'}, {'c': s3.c + 2, 'a': s3.a || 'I', 't': s3.t || chr(10) || 'user:'}])[1] AS i2
        FROM fold p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1) a) b) c
), ends AS (
  SELECT conv_id, list_sort([s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
    {'c': s0.c + 4, 'a': s0.a || 'II', 't': s0.t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] AS best
  FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(best.t[2:]) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_tree.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_token_files": op4_token_files,
        "op5_toxicity": op5_toxicity,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_mil_quality": op7_mil_quality,
        "op8_decontamination": op8_decontamination,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_whitening": op12_whitening,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op11_conversation_repair": OP11_SQL}
