"""Query of the substring removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import substrings
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM i
), f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM f
), o AS (
  SELECT w.doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w
), kept AS (
  SELECT o.doc_id, string_agg(ws[o.k], ' ' ORDER BY o.k) FILTER (c.k IS NULL) AS t, count(c.k) AS gone FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.k = o.k GROUP BY o.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
