"""Query of the fingerprints of all documents and their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.spotsigs import fingerprints


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_spotsigs": op1_spotsigs}
