"""Query of the substring removal over all documents: windows of 35 words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.substring_dedup import removed


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)


QUERIES = {"op2_substring": op2_substring}

ORACLE_SQL = {
    "op2_substring": r"""
WITH toks AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM toks, unnest(range(1, greatest(len(w) - 33, 1))) AS t(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN rep USING (h)),
gone AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM toks),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM word ANTI JOIN hit USING (doc_id, k) GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM toks t LEFT JOIN gone g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
