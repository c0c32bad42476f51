"""Query of the quality classifier over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.quality import classify


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "p_junk", "kept", "pattern")


QUERIES = {"op9_quality": op9_quality}
