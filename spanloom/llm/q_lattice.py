"""Query of the lattice hashing over all vectors: cosine 0.9 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.lattice import linked_vectors


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_lattice": op10_lattice}

ORACLE_SQL = {
    "op10_lattice": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS p, b.vec_id AS q FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.q, r.c FROM r JOIN l ON l.p = r.v),
g AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT p, count(*) AS n FROM l GROUP BY p)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.c AS component_id, e.vec_id = g.c AS kept
FROM embeddings e JOIN g ON g.v = e.vec_id LEFT JOIN n ON n.p = e.vec_id
"""
}
