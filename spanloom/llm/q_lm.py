"""Query of the language model over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.lm import scores


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_lm": op6_lm}
