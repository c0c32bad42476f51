"""Interval algebra on (id, start, end) rows, half open. Everything is keyed by document and stays in the JVM."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T


def clamp(spans: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """spans cut to their texts; those that are empty then, or have a null end, go."""
    size = docs.select(id_column, F.length(F.coalesce(F.col(text_column), F.lit(""))).alias("_size"))
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("_size")))
    return spans.where("start IS NOT NULL AND end IS NOT NULL").join(size, id_column).withColumn("start", inside("start")).withColumn("end", inside("end")).drop("_size").where("start < end")


def merged(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, end) of the unions of spans that overlap or touch."""
    by = Window.partitionBy(id_column).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(id_column, "start", "end").distinct().withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(by))
    return island.groupBy(id_column, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def complement(covered: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, end) of what merged spans leave of each text, texts without spans included."""
    by = Window.partitionBy(id_column).orderBy("start")
    size = docs.select(id_column, F.length(F.coalesce(F.col(text_column), F.lit(""))).alias("_size"))
    edges = covered.select(id_column, "start", "end").unionByName(size.select(id_column, F.col("_size").alias("start"), F.col("_size").alias("end")))
    gaps = edges.select(id_column, F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"), F.col("start").alias("_to"))
    return gaps.where("_from < _to").select(id_column, F.col("_from").alias("start"), F.col("_to").alias("end"))


#: Characters of a cell of long texts; spans meet in the cells that both touch.
CELL = 4096


def overlaps(left: DataFrame, right: DataFrame, id_column: str = "doc_id", cell: int = CELL) -> DataFrame:
    """Pairs of spans of one document that overlap. left: id, start, end and more; right: id, r_start, r_end and more.

    Spans are dealt to the cells they touch; a pair is kept in the first cell that both are in, so it comes once."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / cell)))
    a, b = left.where("start < end").withColumn("_cell", cells("start", "end")), right.where("r_start < r_end").withColumn("_cell", cells("r_start", "r_end"))
    met = a.join(b, [id_column, "_cell"]).where("start < r_end AND r_start < end")
    return met.where(F.col("_cell") == F.floor(F.greatest("start", "r_start") / cell)).drop("_cell")


def neighbours(blocks: DataFrame, spans: DataFrame, size: int, id_column: str = "doc_id", block_column: str = "block_id") -> DataFrame:
    """blocks with the sorted texts of the spans (id, start, end, class, text) that reach within `size` characters."""
    wide = blocks.select(id_column, block_column, F.greatest(F.col("start") - size, F.lit(0)).alias("start"), (F.col("end") + size).alias("end"))
    near = spans.select(id_column, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.struct("start", "end", "class", "text").alias("_span"))
    listed = overlaps(wide, near, id_column).groupBy(id_column, block_column).agg(F.sort_array(F.collect_list("_span")).alias("neighbours"))
    return blocks.join(listed, [id_column, block_column], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(listed.schema["neighbours"].dataType)))


def as_of(points: DataFrame, states: DataFrame, value: str, id_column: str = "doc_id") -> DataFrame:
    """points (id, start and more) with the value of the last state (id, start, value) at or before each."""
    both = points.withColumn("_point", F.lit(True)).unionByName(states.select(id_column, "start", value).withColumn("_point", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy(id_column).orderBy("start", F.col("_point").cast("int"))
    seen = F.last(F.when(~F.col("_point"), F.struct(value)), ignorenulls=True).over(by)
    return both.withColumn("_seen", seen).where("_point").withColumn(value, F.col("_seen")[value]).drop("_seen", "_point")


def kept_passes(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Extractions of several passes (id, pass, ord, start, end and more) of which earlier ones win.

    The first pass is kept whole. A later span is kept if it overlaps nothing kept before it, in its own pass too; spans
    without an interval are always kept. A fold over each document's spans, in the JVM."""
    rest = [c for c in spans.columns if c not in (id_column,)]
    item = F.struct(F.col("pass").alias("_p"), F.col("ord").alias("_o"), *[F.col(c) for c in rest])
    first = lambda a, b: F.when((a["_p"] < b["_p"]) | ((a["_p"] == b["_p"]) & (a["_o"] < b["_o"])), -1).when((a["_p"] == b["_p"]) & (a["_o"] == b["_o"]), 0).otherwise(1)
    listed = spans.groupBy(id_column).agg(F.array_sort(F.collect_list(item), first).alias("_all"))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when((x["_p"] > 0) & F.coalesce(clash, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    kind = listed.schema["_all"].dataType
    return listed.select(id_column, F.explode(F.aggregate("_all", F.array().cast(kind), step)).alias("_x")).select(id_column, *[F.col(f"_x.{c}").alias(c) for c in rest])


# --- lines and headings -------------------------------------------------------------------------------------------------


def line_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line_no, line, start, end, kind) for each line, with its end."""
    cut = docs.select(id_column, F.posexplode(T.lines(F.col(text_column))).alias("line_no", "line"))
    end = F.sum(F.length("line")).over(Window.partitionBy(id_column).orderBy("line_no")).cast("int")
    return cut.withColumn("end", end).withColumn("start", F.col("end") - F.length("line")).withColumn("kind", T.line_kind(F.col("line")))


def marked_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line_no, line, end, start, kind, fenced): fence_lines of line_rows, each document where it lies."""
    key = docs.schema[id_column].dataType.simpleString()
    cut = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = [(x or "").splitlines(keepends=True) for x in part.column("text").to_pylist()]  # the ends of T.LINES
                flat = pa.array(list(itertools.chain.from_iterable(lists)), pa.string())
                marked = np.asarray(pc.match_substring_regex(flat, r"^[ \t\n\x0B\f\r]*(?:```|~~~)").to_numpy(zero_copy_only=False))
                count = np.array([len(x) for x in lists], dtype=np.int64)
                begin = np.cumsum(count) - count
                doc = np.repeat(np.arange(len(count)), count)
                end = np.cumsum(np.concatenate([[0], np.asarray(pc.utf8_length(flat))]))
                fenced, open_, mark, last = np.zeros(len(flat), dtype=bool), -1, None, -1
                stop = lambda d: begin[d] + count[d]
                for k in np.flatnonzero(marked).tolist():
                    if open_ >= 0 and doc[k] != last:  # left open in a text before
                        fenced[open_ : stop(last)] = True
                        open_ = -1
                    last, now = doc[k], flat[k].as_py().lstrip()[:3]
                    if open_ < 0:
                        open_, mark = k, now
                    elif now == mark:
                        fenced[open_ : k + 1], open_ = True, -1
                if open_ >= 0:
                    fenced[open_ : stop(last)] = True
                int32 = lambda x: pa.array(x.astype(np.int32))
                base = end[begin[doc]]
                rows = pa.table([part.column("id").take(pa.array(doc)), int32(np.arange(len(flat)) - begin[doc]), flat, int32(end[1:] - base), int32(end[:-1] - base), pa.array(fenced)], names=["id", "line_no", "line", "end", "start", "fenced"])
                yield from rows.to_batches(max_chunksize=20_000)

    rows = cut.mapInArrow(run, f"id {key}, line_no int, line string, end int, start int, fenced boolean").withColumnRenamed("id", id_column)
    return rows.select(id_column, "line_no", "line", "end", "start", T.line_kind(F.col("line")).alias("kind"), "fenced")


FENCE_MARK = r"^\s*(```|~~~)"


def fence_lines(lines: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """lines with fenced: is the line a fence mark or inside a fence? A fence closes with a mark of its own kind, or at
    the end. The marks are folded per document; there are few."""
    mark = F.regexp_extract("line", FENCE_MARK, 1)
    marks = lines.withColumn("_mark", mark).where("_mark <> ''")
    listed = marks.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("line_no", "_mark"))).alias("_marks"))
    zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(None).cast("int").alias("open"), F.lit(None).cast("string").alias("with"))

    def step(s: Column, m: Column) -> Column:
        opens = F.struct(s["done"].alias("done"), m["line_no"].alias("open"), m["_mark"].alias("with"))
        closes = F.struct(F.concat(s["done"], F.array(F.struct(s["open"].alias("a"), m["line_no"].alias("b")))).alias("done"), F.lit(None).cast("int").alias("open"), F.lit(None).cast("string").alias("with"))
        return F.when(s["open"].isNull(), opens).when(s["with"] == m["_mark"], closes).otherwise(s)

    folded = listed.withColumn("_s", F.aggregate("_marks", zero, step))
    fences = folded.select(id_column, F.explode(F.concat(F.col("_s.done"), F.when(F.col("_s.open").isNotNull(), F.array(F.struct(F.col("_s.open").alias("a"), F.lit(2**31 - 1).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>")))).alias("_f"))
    inside = lines.join(fences, id_column).where(F.col("line_no").between(F.col("_f.a"), F.col("_f.b"))).select(id_column, "line_no").withColumn("fenced", F.lit(True))
    return lines.join(inside, [id_column, "line_no"], "left").withColumn("fenced", F.coalesce("fenced", F.lit(False)))


def fence_spans(fenced: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, end) of whole fences, from lines with fenced. Fences that follow each other at once are one span."""
    return merged(fenced.where("fenced").select(id_column, "start", "end"), id_column)


def heading_rows(fenced: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, end, level, heading) of heading lines outside fences; spaces may stand before the marks."""
    bare = F.regexp_replace("line", r"^(?U)\s+", "")
    rows = fenced.where(~F.col("fenced")).withColumn("_bare", bare).where(F.regexp_replace("_bare", r"[\r\n]+$", "").rlike(T.HEADING))
    return rows.select(id_column, "start", "end", T.heading_level(F.col("_bare")).alias("level"), T.strip(F.col("_bare")).alias("heading"))


def heading_trees(headings: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """headings with tree: the first level - 1 entries of the tree before, and the heading itself."""
    key, at = headings.schema[id_column].dataType.simpleString(), headings.schema["start"].dataType.simpleString()
    listed = headings.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("start", "level", "heading"))).alias("_h")).withColumnRenamed(id_column, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                flat, doc = part.column("_h").flatten(), pc.list_parent_indices(part.column("_h"))
                start, level, heading = flat.flatten()
                trees, tree, last = [], [], None
                for d, n, text in zip(doc.to_pylist(), level.to_pylist(), heading.to_pylist(), strict=True):
                    tree, last = [*(tree[: n - 1] if d == last else ()), text], d
                    trees.append(tree)
                yield pa.RecordBatch.from_arrays([part.column("id").take(doc), start, pa.array(trees, pa.list_(pa.string()))], names=["id", "start", "tree"])

    return listed.mapInArrow(run, f"id {key}, start {at}, tree array<string>").withColumnRenamed("id", id_column)


def toc_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, end) of regions between table-of-contents comments."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    pattern = r"(?s)<!--\s*toc\s*-->.*?<!--\s*/toc\s*-->"
    parts = F.arrays_zip(F.split(text, pattern).alias("before"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))
    rows = docs.select(id_column, F.posexplode(parts).alias("_k", "_p"))
    both = F.length("_p.before") + F.coalesce(F.length("_p.hit"), F.lit(0))
    end = F.sum(both).over(Window.partitionBy(id_column).orderBy("_k")).cast("int")
    return rows.withColumn("end", end).where(F.col("_p.hit").isNotNull()).select(id_column, (F.col("end") - F.length("_p.hit")).alias("start"), "end")


def section_text(docs: DataFrame, headings: DataFrame, heading: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, section): the first heading of that text, its own body, and of the sections below only their heading lines."""
    by = Window.partitionBy(id_column).orderBy("start")
    nexts = headings.withColumn("_next", F.lead("start").over(by))
    first = nexts.where(F.col("heading") == heading).groupBy(id_column).agg(F.min_by(F.struct(F.col("start").alias("s"), F.col("level").alias("l")), "start").alias("_f"))
    after = nexts.join(first, id_column).where(F.col("start") >= F.col("_f.s"))
    stop = after.where((F.col("start") > F.col("_f.s")) & (F.col("level") <= F.col("_f.l"))).groupBy(id_column).agg(F.min("start").alias("_stop"))
    inside = after.join(stop, id_column, "left").where(F.col("_stop").isNull() | (F.col("start") < F.col("_stop")))
    texts = docs.select(id_column, F.col(text_column).alias("_text"))
    part = F.when(F.col("start") == F.col("_f.s"), T.span(F.col("_text"), F.col("start"), F.coalesce("_next", F.length("_text")))).otherwise(T.span(F.col("_text"), F.col("start"), F.col("end")))
    return inside.join(texts, id_column).groupBy(id_column).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", part.alias("part")))), lambda x: x["part"]), "").alias("section"))


def slice_without(docs: DataFrame, holes: DataFrame, start: Column, end: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, left): text[start:end] without the merged holes."""
    sliced = docs.select(id_column, F.col(text_column).alias("_text"), start.alias("_a"), end.alias("_b"))
    gaps = complement(merged(holes, id_column), docs, id_column, text_column)
    part = sliced.join(gaps, id_column, "left").withColumn("_s", F.greatest("start", "_a")).withColumn("_e", F.least("end", "_b"))
    text = F.when(F.col("_s") < F.col("_e"), T.span(F.col("_text"), F.col("_s"), F.col("_e"))).otherwise("")
    return part.groupBy(id_column).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_s", text.alias("part")))), lambda x: x["part"]), "").alias("left"))


# --- highlighting -------------------------------------------------------------------------------------------------------


def highlight_events(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Boundaries of spans (id, span_id, start, end) in drawing order: ends before starts at one place, longer spans
    open first and close last."""
    size = F.col("end") - F.col("start")
    both = spans.where("start < end").select(id_column, "span_id", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit("start").alias("event"), (-size).alias("rank")), F.struct(F.col("end").alias("pos"), F.lit("end").alias("event"), size.alias("rank")))).alias("_e"))
    rows = both.select(id_column, "span_id", F.col("_e.pos").alias("pos"), F.col("_e.event").alias("event"), F.col("_e.rank").alias("_rank"))
    place = F.row_number().over(Window.partitionBy(id_column).orderBy("pos", F.when(F.col("event") == "end", 0).otherwise(1), "_rank", "span_id")) - 1
    return rows.withColumn("ord", place.cast("int")).drop("_rank")
