"""Text that no extraction covers: covered spans, gaps, cleaned residual blocks with their heading trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import intervals as I
from spanloom.sources import shared


def covered(docs: DataFrame, extractions: DataFrame, *, ignore: tuple[str, ...] = (), fences: bool = False, id_column: str = "doc_id", text_column: str = "text", fenced: DataFrame | None = None) -> DataFrame:
    """(id, start, end): merged spans of extractions of classes that aren't ignored, tables of contents, heading lines,
    and fences if they are to be left out. Extractions (id, class, start, end) need 0 <= start < end. fenced: fence_lines
    of docs, if already at hand."""
    fenced = fenced if fenced is not None else I.marked_lines(docs, id_column, text_column)
    spans = extractions.where("start >= 0 AND start < end")
    spans = spans.where(~F.col("class").isin(*ignore)) if ignore else spans
    every = spans.select(id_column, "start", "end").unionByName(I.toc_spans(docs, id_column, text_column)).unionByName(I.heading_rows(fenced, id_column).select(id_column, "start", "end"))
    every = every.unionByName(I.fence_spans(fenced, id_column)) if fences else every
    return I.merged(I.clamp(every, docs, id_column, text_column), id_column)


def _trimmed(rows: DataFrame) -> DataFrame:
    left, right = T.left_space(F.col("text")), T.right_space(F.col("text"))
    moved = rows.withColumn("_l", left).withColumn("_r", F.when(F.length("text") > left, right).otherwise(0))
    return moved.withColumn("start", F.col("start") + F.col("_l")).withColumn("end", F.col("end") - F.col("_r")).withColumn("text", T.strip(F.col("text"))).drop("_l", "_r")


def clean_blocks(raw: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Blocks (id, start, end, text, tree) cleaned and numbered from 0: tables of contents, addresses and lone headings
    go; a leading heading moves into the tree; what is empty or only marks then goes. Each step is written, so that no
    step's expressions are repeated inside those of the next."""
    t = F.col("text")
    kept = shared.written(_trimmed(raw.where(~T.is_toc_text(t) & ~T.is_url_text(t) & ~T.is_heading_text(t))), "trimmed").where(~T.is_empty_text(t) & ~T.is_url_text(t))
    head = T.leading_heading(t)
    split = kept.withColumn("_head", head).where((F.col("_head") == "") | (T.strip(F.substring(t, F.length("_head") + 1, F.length(t))) != ""))
    moved = split.withColumn("tree", F.when(F.col("_head") != "", F.concat("tree", F.array(T.strip(F.col("_head"))))).otherwise(F.col("tree")))
    moved = moved.withColumn("start", F.col("start") + F.length("_head")).withColumn("text", F.substring(t, F.length("_head") + 1, F.length(t))).drop("_head")
    last = shared.written(_trimmed(shared.written(moved, "moved")), "trimmed").where((F.col("start") < F.col("end")) & ~T.is_empty_text(t) & ~T.is_url_text(t))
    return last.withColumn("block_id", (F.row_number().over(Window.partitionBy(id_column).orderBy("start")) - 1).cast("int"))


def residual_blocks(docs: DataFrame, extractions: DataFrame, *, ignore: tuple[str, ...] = (), fences: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, block_id, start, end, text, tree) of what the extractions leave of each text. Texts, marked lines and raw blocks are
    written to the shared folder, as several steps read them."""
    docs = shared.written(docs.select(id_column, text_column), "texts")
    fenced = shared.written(I.marked_lines(docs, id_column, text_column).drop("kind"), "fenced")
    gaps = I.complement(covered(docs, extractions, ignore=ignore, fences=fences, id_column=id_column, text_column=text_column, fenced=fenced), docs, id_column, text_column)
    trees = I.heading_trees(I.heading_rows(fenced, id_column), id_column)
    placed = I.as_of(gaps, trees, "tree", id_column).withColumn("tree", F.coalesce("tree", F.array().cast("array<string>")))
    texts = docs.select(id_column, F.col(text_column).alias("_text"))
    raw = placed.join(texts, id_column).withColumn("text", T.span(F.col("_text"), F.col("start"), F.col("end"))).drop("_text")
    return clean_blocks(shared.written(raw, "raw"), id_column).select(id_column, "block_id", "start", "end", "text", "tree")


def coverage(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, covered_chars, ratio) by merged spans."""
    total = spans.groupBy(id_column).agg(F.sum(F.col("end") - F.col("start")).alias("covered_chars"))
    size = docs.select(id_column, F.length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("n_chars"))
    out = size.join(total, id_column, "left").withColumn("covered_chars", F.coalesce("covered_chars", F.lit(0)).cast("long"))
    return out.withColumn("ratio", F.round(T.safe_ratio(F.col("covered_chars"), F.col("n_chars")), 6))


def blocks_by_id(blocks: DataFrame, wanted: list[int], id_column: str = "doc_id") -> DataFrame:
    """The blocks of these numbers in the order asked for; a missing one is an error on its row."""
    spark = blocks.sparkSession
    asked = spark.createDataFrame([(k, b) for k, b in enumerate(wanted)], "ord int, block_id int")
    found = F.broadcast(asked).join(blocks, "block_id", "left")
    missing = F.raise_error(F.concat(F.lit("no such block: "), F.col("block_id").cast("string"))).cast(blocks.schema[id_column].dataType)
    return found.withColumn(id_column, F.coalesce(F.col(id_column), missing)).orderBy("ord")


def neighbour_texts(docs: DataFrame, blocks: DataFrame, level: str = "medium", *, drop_fences: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """blocks with the text before and after each; fences there can be left out."""
    size = F.lit(T.CONTEXT_SIZES[level])
    both = blocks.join(docs.select(id_column, F.col(text_column).alias("_text")), id_column)
    before, after = T.neighbour_text(F.col("_text"), F.col("start"), F.col("end"), size)
    strip = (lambda c: F.regexp_replace(c, r"(?s)(```|~~~).*?(\1|$)", "")) if drop_fences else (lambda c: c)
    return both.withColumn("before", strip(before)).withColumn("after", strip(after)).drop("_text")


def document_json(blocks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, json) of each document's blocks, in their order."""
    item: Column = F.struct("block_id", "text", F.struct(F.col("start").alias("start_pos"), F.col("end").alias("end_pos")).alias("char_interval"), F.col("tree").alias("heading_tree"))
    return blocks.groupBy(id_column).agg(F.to_json(F.struct(F.col(id_column).cast("string").alias("original_doc_ref"), F.sort_array(F.collect_list(item)).alias("resblocks"))).alias("json"))
