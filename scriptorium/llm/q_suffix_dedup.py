"""Query op6: long repeats removed from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .suffix_dedup import dedupe_substrings

LENGTH = 200


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_substrings(docs, length=LENGTH).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = r"""
WITH data AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS i FROM data WHERE octet_length(b) >= 200),
digests AS MATERIALIZED (SELECT s.doc_id, i, md5(array_slice(b, i, i + 199)) AS h FROM starts s JOIN data USING (doc_id)),
often AS (SELECT h FROM digests GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM digests WHERE h IN (SELECT h FROM often)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, e FROM spans UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM data),
kept AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a, e), 1) AS f FROM cuts)
SELECT k.doc_id, octet_length(any_value(b)) AS n_bytes, sum(e - a)::BIGINT AS n_removed, count(*) - 1 AS n_spans,
       sha256(unhex(coalesce(string_agg(CASE WHEN a > f THEN hex(array_slice(b, f, a - 1)) ELSE '' END, '' ORDER BY a, e), ''))) AS kept_sha256
FROM kept k JOIN data USING (doc_id) GROUP BY k.doc_id
"""
