"""Query of the phrase collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import phrases
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), i AS (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(ws) >= m
), f AS (
  SELECT lang, phrase, m, count(*) AS a FROM (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM i) GROUP BY lang, phrase, m
), c AS (
  SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30
), k AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST((CAST(k.a AS HUGEINT) * 2000000) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp
), b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1
), j AS (
  SELECT lang, a, m, ws, unnest(range(2, m)) AS q FROM c WHERE m > 2
), t AS (
  SELECT lang, array_to_string(ws[z:z + q - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, m - q + 2)) AS z FROM j) GROUP BY ALL
), d AS (
  SELECT b.* FROM b LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase WHERE t.most IS NULL OR CAST(t.most AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * 80
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d
)
SELECT r.lang, rank, phrase, a, l, r.r, n.n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
