"""Query of the SentencePiece encoding over all documents, decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.pieces import encode

MODEL = "piece_bpe_32k.model"


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL, ids=False)
    return coded.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


QUERIES = {"op5_pieces": op5_pieces}
