"""Queries that need a tokenizer's ids: counts and packing, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.packing import pack
from spanloom.llm.tokens import token_counts

TOKENIZER = "byte_bpe_50k.json"


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)


QUERIES = {"op4_token_counts": op4_token_counts, "op8_packing": op8_packing}
