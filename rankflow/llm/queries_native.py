"""Queries of the operators that run on DataFrame and SQL functions only, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import mixing, quality_rules, sharding
from rankflow.llm.common import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the rules are learned from all labels."""
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``."""
    rows = sharding.interleave_shards(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32: the checksum is folded bit by bit over the text's hex digits.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, coalesce(strlen(text), 0) + 8 AS size,
         md5(concat_ws('-', '42', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k
  FROM documents
), bits AS (
  SELECT *, list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)],
        flatten(list_transform(list_transform(regexp_extract_all(hex(t), '..'), lambda h: CAST(concat('0x', h) AS INTEGER)),
          lambda v: [v & 1, (v >> 1) & 1, (v >> 2) & 1, (v >> 3) & 1, (v >> 4) & 1, (v >> 5) & 1, (v >> 6) & 1, (v >> 7) & 1]))),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) AS c
  FROM d
), r AS (
  SELECT *, xor(c, 4294967295) AS text_crc32,
    row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size) AS rn, count(*) OVER (PARTITION BY source) AS n
  FROM bits
), f AS (
  SELECT *, CAST(2 * rn - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE) AS fr FROM r
), g AS (
  SELECT *, row_number() OVER (ORDER BY fr, source IS NULL, source, k, doc_id NULLS FIRST, text_crc32, size) - 1 AS spot, count(*) OVER () AS total FROM f
), s AS (SELECT *, (spot * 24) // total AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(spot - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what a mix of 150% of all words takes of each."""
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, max_repeats=2)
    return planned.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('-', '42', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS DOUBLE) AS wt, 2 * source_size AS cap FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
    CAST(sum(cap) OVER o - cap AS DOUBLE) AS before, sum(wt) OVER () - sum(wt) OVER o + wt AS rest
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), l AS (
  SELECT *, (budget - before) / rest AS lvl, CAST(cap AS DOUBLE) <= (budget - before) / rest * wt AS full_ FROM c
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE wt *
    (SELECT lvl FROM l WHERE NOT full_ ORDER BY CAST(cap AS DOUBLE) / wt, source NULLS LAST LIMIT 1) END AS target FROM l
), p AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS spot
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (
    CASE WHEN size > 0 AND 2 * spot + size < 2 * target THEN 1 ELSE 0 END +
    CASE WHEN size > 0 AND 2 * (source_size + spot) + size < 2 * target THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""

QUERIES = {"op2_quality_rules": op2_quality_rules, "op3_sharding": op3_sharding, "op6_mixing": op6_mixing}
ORACLE_SQL = {"op3_sharding": OP3_SQL, "op6_mixing": OP6_SQL}
