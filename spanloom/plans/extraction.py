"""Documents to grounded extractions: chunk, prompt, ask, parse, align, merge passes. Chunks are written once; one lazy plan per pass."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import parsing as P
from spanloom.operators import inference as N
from spanloom.operators import intervals as I
from spanloom.operators.align import AlignConfig, align, align_rows
from spanloom.operators.chunks import ChunkPolicy, sentence_chunk_rows, structured_chunk_rows, with_previous
from spanloom.sources import shared

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ExtractConfig:
    """structured: Markdown-aware chunks. previous: characters of the chunk before that a prompt shows."""

    limit: int = 1000
    structured: bool = False
    previous: int = 0
    passes: int = 1
    batch: int = 10
    workers: int = 1
    index_suffix: str | None = None
    suppress_parse_errors: bool = False
    example_level: str = "warning"
    strict_examples: bool = False
    policy: ChunkPolicy = field(default_factory=ChunkPolicy)
    alignment: AlignConfig = field(default_factory=AlignConfig)


class ExampleError(ValueError):
    """Examples that their own texts don't ground."""


def guard_examples(template: N.Template, config: AlignConfig, level: str = "warning", *, strict: bool = False) -> list[str]:
    """Applies a policy to the examples before anything is asked: off looks at nothing, warning logs what is wrong, error
    stops at examples that aren't found (or, if strict, aren't found exactly). Gives what was logged."""
    if level not in ("off", "warning", "error"):
        raise ValueError(f"unknown level: {level}")
    if level == "off":
        return []
    found = check_examples(template, config, strict=True)
    for line in found:
        log.warning("%s", line)
    if level == "error" and (stops := check_examples(template, config, strict=strict)):
        raise ExampleError(f"{len(stops)} example extractions can't be grounded, the first: {stops[0]}")
    return found


def check_examples(template: N.Template, config: AlignConfig, *, strict: bool = False) -> list[str]:
    """What is wrong with the examples: extractions that their own texts don't ground, or not exactly if strict."""
    out = []
    for k, e in enumerate(template.examples):
        for (cls, text, _), (status, *_) in zip(e.extractions, align(e.text, [t for _, t, _ in e.extractions], config), strict=True):
            if status is None or (strict and status != "match_exact"):
                out.append(f"example {k}: {cls} {text[:120]!r} is {status or 'not found'}")
    return out


def chunk_documents(docs: DataFrame, config: ExtractConfig) -> DataFrame:
    """docs: doc_id, text."""
    chunks = structured_chunk_rows(docs, config.policy) if config.structured else sentence_chunk_rows(docs, config.limit)
    return with_previous(chunks, config.previous) if config.previous else chunks


def extract_pass(chunks: DataFrame, template: N.Template, provider: N.Provider, config: ExtractConfig, memo: DataFrame | None = None, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(grounded extractions, new memo rows) of one pass. A model or parse error stops the job unless suppressed; then
    its chunk gives nothing."""
    asked, news = N.infer(N.prompts(chunks, template), provider, memo, model=model, batch=config.batch, workers=config.workers)
    parsed = P.parse_outputs(asked)
    problem = F.coalesce("error", "parse_error", P.first_value_error(F.col("groups"), config.index_suffix))
    parsed = parsed.withColumn("problem", problem)
    if not config.suppress_parse_errors:
        fail = F.raise_error(F.concat(F.lit("chunk "), F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk").cast("string"), F.lit(": "), F.col("problem"))).cast(P.GROUPS)
        parsed = parsed.withColumn("groups", F.when(F.col("problem").isNotNull(), fail).otherwise(F.col("groups")))
    else:
        parsed = parsed.where("problem IS NULL")
    flat = P.flatten(parsed, ["doc_id", "chunk"], config.index_suffix).withColumnRenamed("extraction_index", "ord")
    return align_rows(chunks, flat, config.alignment), news


def extract(docs: DataFrame, template: N.Template, provider: N.Provider, config: ExtractConfig | None = None, *, model: str = "model") -> DataFrame:
    """(doc_id, ord, class, text, attributes, status, intervals, pass) for each extraction; several passes are merged,
    earlier ones win."""
    config = config or ExtractConfig()
    if not template.examples:
        raise ValueError("examples are needed")
    guard_examples(template, config.alignment, config.example_level, strict=config.strict_examples)
    chunks = shared.written(chunk_documents(docs, config), "chunks")  # prompts, answers and alignment read them
    found = None
    for k in range(config.passes):
        rows = extract_pass(chunks, template, provider, config, model=f"{model}#{k}" if k else model)[0].withColumn("pass", F.lit(k))
        found = rows if found is None else found.unionByName(rows)
    if config.passes == 1:
        return found
    numbered = found.withColumn("ord", F.col("chunk").cast("long") * 1_000_000 + F.col("ord"))
    return I.kept_passes(numbered, "doc_id")


def annotated(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """(document_id, text, extractions) in the order of document ids: every document of docs (doc_id, text) with its
    extractions (doc_id, ord, class, text, attributes, status) in their order, none for those without. A repeated id is
    an error."""
    item = F.struct(F.col("ord").cast("int").alias("extraction_index"), F.col("class").alias("extraction_class"), F.col("text").alias("extraction_text"), "attributes", F.col("status").alias("alignment_status"))
    order = lambda a, b: a["extraction_index"] - b["extraction_index"]
    listed = extractions.groupBy("doc_id").agg(F.array_sort(F.collect_list(item), order).alias("extractions"))
    again = F.raise_error(F.concat(F.lit("repeated document id: "), F.col("doc_id").cast("string"))).cast("string")
    once = docs.groupBy("doc_id").agg(F.count("*").alias("_n"), F.first("text").alias("_text"))
    rows = once.join(listed, "doc_id", "left").withColumn("text", F.when(F.col("_n") > 1, again).otherwise(F.col("_text")))
    none = F.array().cast(listed.schema["extractions"].dataType)
    return rows.orderBy("doc_id").select(F.col("doc_id").cast("string").alias("document_id"), "text", F.coalesce("extractions", none).alias("extractions"))


def summary(extractions: DataFrame) -> DataFrame:
    """Extractions, distinct classes and chunks of each document."""
    return extractions.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("class").alias("classes"), F.countDistinct("chunk").alias("chunks"))
