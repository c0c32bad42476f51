"""Query of the MinHash operator over all documents: three-word shingles, similarity 0.85 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.minhash import MinHashConfig, near_duplicates


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), MinHashConfig(shingle=3, percent=85))


QUERIES = {"op3_minhash": op3_minhash}

#: All pairs that share a shingle, confirmed by counts, and reachability over the links.
ORACLE_SQL = {
    "op3_minhash": r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM toks),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.k + b.k - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v),
g AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, g.c AS component_id, d.doc_id = g.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN g ON g.v = d.doc_id
"""
}
