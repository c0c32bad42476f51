"""From raw documents to packed training sequences: classify, drop near duplicates, cut repeated passages, pack.

In every stage null and empty texts stay documents (packed as a lone end token), null ids are rows like others, repeated
rows are copies of each other, texts may be of any length, other columns stay as they are whatever their names, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.minhash import keep_one
from spanloom.llm.packing import pack
from spanloom.llm.quality import keep_good
from spanloom.llm.scratch import Scratch
from spanloom.llm.substring_dedup import cleaned

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those without words have nothing to judge and stay."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays. Documents without an id or without words are
    in no group and stay; of rows of one id one stays."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that start more than once are cut; n_chars follows the text, null with it."""
    return cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a row for each piece of a document, a null text is just the end token."""
    return pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: The stages cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents; each result is written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
