"""Sentence chunks, Markdown blocks, containers and structure-aware chunks.

These are folds with a state that only the text before determines, so each document is folded where it lies: one Arrow
pass, no shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spanloom.functions import text as T
from spanloom.operators.tokens import Tokens, scan
from spanloom.sources import shared

# --- sentence chunks ----------------------------------------------------------------------------------------------------


def sentence_chunks(tokens: Tokens, limit: int) -> list[tuple[int, int]]:
    """Token ranges of at most `limit` characters: whole sentences while they fit; a longer sentence is cut at its last
    line start that fits, else where it must be; a longer token stands alone. What is left of a cut sentence isn't
    joined with the next one."""
    n, out = len(tokens), []
    ends, follows, closing = tokens.stops()
    stop_at = np.flatnonzero(ends | follows)
    line_at = np.flatnonzero(tokens.nl)

    def sentence(at: int) -> int:
        k = np.searchsorted(stop_at, at)
        if k == len(stop_at):
            return n
        to = int(stop_at[k]) + 1
        while ends[stop_at[k]] and to < n and closing[to]:
            to += 1
        return to

    at, left_over = 0, False
    while at < n:
        to = sentence(at)
        fits = int(np.searchsorted(tokens.end, tokens.start[at] + limit, side="right"))
        if fits <= at:
            out.append((at, at + 1))
            left_over, at = at + 1 < to, at + 1
            continue
        if fits < to:
            k = np.searchsorted(line_at, fits, side="right") - 1
            cut = int(line_at[k]) if k >= 0 and line_at[k] > at else fits
            out.append((at, cut))
            left_over, at = True, cut
            continue
        if left_over:
            left_over = False
        else:
            while to < n and (more := sentence(to)) <= fits:
                to = more
        out.append((at, to))
        at = to
    return out


# --- Markdown blocks ----------------------------------------------------------------------------------------------------

_KINDS = [(kind, re.compile(pattern)) for kind, pattern in (("heading", T.HEADING), ("code_fence", T.FENCE), ("checklist_item", T.CHECKLIST), ("numbered_item", T.NUMBERED), ("bullet_item", T.BULLET), ("blockquote", T.QUOTE))]
_PATTERN = dict(_KINDS)
#: A link to an anchor of the same text. Fixed pattern.
_LINK = re.compile(r"\[[^\]]+\]\(#[-a-z0-9_]+\)", re.IGNORECASE)


def _kind(line: str) -> str:
    if not line.strip():
        return "blank"
    for kind in ("heading", "code_fence"):
        if _PATTERN[kind].match(line):
            return kind
    if line.count("|") >= 2 and not _PATTERN["blockquote"].match(line):
        return "table"
    return next((k for k in ("checklist_item", "numbered_item", "bullet_item", "blockquote") if _PATTERN[k].match(line)), "paragraph")


@dataclass
class Block:
    block: int
    kind: str
    start: int
    end: int
    first_token: int
    end_token: int
    level: int
    indent: int
    path: list[int]
    raw: str


def blocks(text: str, tokens: Tokens) -> list[Block]:
    """The text's structure blocks in order. path: the blocks of the headings above."""
    lines = text.splitlines(keepends=True)
    at = [0, *itertools.accumulate(map(len, lines))]
    first_of = np.searchsorted(tokens.end, at, side="right").tolist()
    last_of = np.searchsorted(tokens.start, at, side="left").tolist()
    kinds = [_kind(x) for x in lines]
    out: list[Block] = []
    above: list[tuple[int, int]] = []
    k = 0
    while k < len(lines):
        kind, to = kinds[k], k + 1
        if kind == "blank":
            k = to
            continue
        indent = 0
        if kind == "code_fence":
            close = re.compile(rf"\s*{re.escape(_PATTERN[kind].match(lines[k]).group(1)[0])}{{3,}}")
            to = next((j + 1 for j in range(k + 1, len(lines)) if close.match(lines[j])), len(lines))
        elif kind == "table":
            while to < len(lines) and lines[to].strip().count("|") >= 2 and not _PATTERN["blockquote"].match(lines[to]):
                to += 1
        elif kind.endswith("_item"):
            indent = len(_PATTERN[kind].match(lines[k]).group(1))
            while to < len(lines) and kinds[to] == "paragraph" and len(lines[to]) - len(lines[to].lstrip(" ")) > indent:
                to += 1
        elif kind == "blockquote":
            while to < len(lines) and lines[to].strip() and _PATTERN["blockquote"].match(lines[to]):
                to += 1
        elif kind == "paragraph":
            while to < len(lines) and kinds[to] == "paragraph":
                to += 1
        start, end, first, last = at[k], at[to], first_of[k], last_of[to]
        if first < last:
            level = len(_PATTERN["heading"].match(lines[k]).group(1)) if kind == "heading" else 0
            if kind == "heading":
                while above and above[-1][0] >= level:
                    above.pop()
            raw = lines[k].rstrip("\r\n") if kind == "heading" else "".join(lines[k:to])
            out.append(Block(len(out), kind, start, end, first, last, level, indent, [b for _, b in above], raw))
            if kind == "heading":
                above.append((level, out[-1].block))
        k = to
    return out


# --- containers ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChunkPolicy:
    """Limits of a chunk and what is left out."""

    limit: int = 1000
    min_fill: float = 0.6
    preferred_fill: float = 1.0
    max_containers: int = 10
    max_kinds: int = 10
    skip_toc: bool = True
    skip_checklist: bool = True
    skip_code_fence: bool = True
    skip_table: bool = True


#: Fixed values of the table-of-contents rule.
TOC_TITLES = ("table of contents", "contents")
TOC_OPEN = ("<!-- toc -->", "<!--toc-->")
TOC_CLOSE = ("<!-- /toc -->", "<!--/toc-->")


def _toc_entry(block: Block) -> bool:
    links = len(_LINK.findall(block.raw))
    return block.kind in ("bullet_item", "numbered_item") and links >= max(1, sum(bool(x.strip()) for x in block.raw.splitlines()))


def toc_blocks(found: list[Block]) -> set[int]:
    """The blocks of a leading table of contents; none without a list of links."""
    begin = None
    for b in found[:20]:
        bare = b.raw.strip()
        if b.kind == "heading" and b.level == 2 and bare.lstrip("#").strip().lower() in TOC_TITLES:
            begin, marked = b.block, False
            break
        if bare.lower() in TOC_OPEN:
            begin, marked = b.block, True
            break
    if begin is None:
        return set()
    region = {begin}
    for b in found[begin + 1 :]:
        bare = b.raw.strip().lower()
        if b.kind == "heading":
            break
        if bare in TOC_CLOSE:
            region.add(b.block)
            break
        if bare in TOC_OPEN:
            marked = True
        elif not (_toc_entry(b) or (marked and b.kind == "paragraph" and bare.startswith("<!--") and bare.endswith("-->"))):
            break
        region.add(b.block)
    return region if any(_toc_entry(found[k]) for k in region) else set()


def skip_reason(block: Block, toc: set[int], policy: ChunkPolicy) -> str | None:
    """Why a block is left out, or None."""
    if block.kind == "heading" and block.level == 1:
        return "skip_document_title"
    if policy.skip_toc and block.block in toc:
        return "skip_toc"
    if block.kind in ("checklist_item", "code_fence", "table") and getattr(policy, f"skip_{block.kind.removesuffix('_item')}"):
        return f"skip_{block.kind.removesuffix('_item')}"
    return None


@dataclass
class Container:
    container: int
    kind: str
    members: list[int]
    first_token: int
    end_token: int
    context: list[int]


def containers(found: list[Block], policy: ChunkPolicy) -> list[Container]:
    """Lists, headings with their own body, prose runs and single blocks."""
    toc, out, k = toc_blocks(found) if policy.skip_toc else set(), [], 0
    skipped = [skip_reason(b, toc, policy) is not None for b in found]

    def run(kinds: tuple[str, ...]) -> int:
        to = k + 1
        while to < len(found) and found[to].kind in kinds and found[to].path == found[k].path:
            to += 1
        return to

    while k < len(found):
        b, context = found[k], []
        if skipped[k]:
            k += 1
            continue
        if b.kind in ("bullet_item", "numbered_item"):
            to = run(("bullet_item", "numbered_item"))
            kind, members = "list", found[k:to]
        elif b.kind == "heading":
            to = k + 1
            while to < len(found) and found[to].kind != "heading" and (found[to].path[-1] == b.block if found[to].path else found[to].kind == "paragraph"):
                to += 1
            members = [b, *(x for x in found[k + 1 : to] if not skipped[x.block])]
            kind, context = "qa" if b.raw.rstrip().endswith("?") else "subtree", b.path
        elif b.kind in ("checklist_item", "code_fence", "table"):
            to, kind, members = k + 1, "isolated", [b]
        else:
            to = run(("paragraph", "blockquote"))
            kind, members, context = "prose", found[k:to], b.path
        out.append(Container(len(out), kind, [x.block for x in members], members[0].first_token, members[-1].end_token, context))
        k = to
    return out


# --- structure-aware chunks ---------------------------------------------------------------------------------------------


@dataclass
class Chunk:
    chunk: int
    first_token: int
    end_token: int
    start: int
    end: int
    containers: list[int]
    decision: str
    context: list[list[int]]


def structured_chunks(tokens: Tokens, found: list[Container], policy: ChunkPolicy) -> list[Chunk]:
    """Containers joined while they fit; one that is too long is cut into sentence chunks."""
    out: list[Chunk] = []
    held: list[Container] = []
    size = lambda a, b: max(0, int(tokens.end[b - 1] - tokens.start[a]))

    def emit(a: int, b: int, of: list[Container], decision: str) -> None:
        context: list[list[int]] = []
        for c in of:
            if c.context and c.context not in context:
                context.append(c.context)
        out.append(Chunk(len(out), a, b, int(tokens.start[a]), int(tokens.end[b - 1]), [c.container for c in of], decision, context))

    def flush() -> None:
        if held:
            emit(held[0].first_token, held[-1].end_token, held, "merged")
            held.clear()

    for c in found:
        if size(c.first_token, c.end_token) > policy.limit:
            flush()
            a, b = int(tokens.start[c.first_token]), int(tokens.end[c.end_token - 1])
            part = scan(tokens.text[a:b])
            for x, y in sentence_chunks(part, policy.limit):
                emit(c.first_token + x, c.first_token + y, [c], "fallback")
            continue
        if held:
            whole = size(held[0].first_token, c.end_token)
            now = size(held[0].first_token, held[-1].end_token)
            joins = whole <= policy.limit and len(held) < policy.max_containers and len({x.kind for x in [*held, c]}) <= policy.max_kinds and (now < policy.limit * policy.min_fill or whole <= policy.limit * policy.preferred_fill)
            if not joins:
                flush()
        held.append(c)
    flush()
    return out


# --- over tables --------------------------------------------------------------------------------------------------------


#: Most rows, and about most characters, of one frame that a task gives out.
FRAME_ROWS, FRAME_CHARACTERS = 10_000, 1 << 21


def _per_document(docs: DataFrame, work: Callable[[str], Iterator[tuple]], schema: str, id_column: str, text_column: str) -> DataFrame:
    """The rows that `work` gives for each text, with its id. Texts are taken out of the batch one by one, and rows go out
    in small frames, so that a task holds little besides the batch whatever the sizes of texts and results."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows_type = to_arrow_schema(_parse_datatype_string(f"id {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, of, size = [], [], 0
            for k, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                size += len(text)
                for row in work(text):
                    held.append(row)
                    of.append(k)
                    if len(held) >= FRAME_ROWS:
                        yield frame(batch, of, held)
                        held, of = [], []
                if size >= FRAME_CHARACTERS:
                    yield frame(batch, of, held)
                    held, of, size = [], [], 0
            yield frame(batch, of, held)

    def frame(batch: pa.RecordBatch, of: list[int], held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ((),) * (len(rows_type) - 1)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of, pa.int32())), *(pa.array(c, f.type) for c, f in zip(columns, list(rows_type)[1:], strict=True))], names=rows_type.names)

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_column)


def sentence_chunk_rows(docs: DataFrame, limit: int = 1000, *, id_column: str = "doc_id", text_column: str = "text", unicode_graphemes: bool = False) -> DataFrame:
    """(id, chunk, first_token, end_token, start, end, chunk_text) for each sentence chunk."""

    def work(text: str) -> Iterator[tuple]:
        tokens = scan(text, unicode_graphemes)
        for k, (a, b) in enumerate(sentence_chunks(tokens, limit)):
            start, end = int(tokens.start[a]), int(tokens.end[b - 1])
            yield k, a, b, start, end, text[start:end]

    return _per_document(docs, work, "chunk int, first_token int, end_token int, start int, end int, chunk_text string", id_column, text_column)


def block_rows(docs: DataFrame, policy: ChunkPolicy | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, block, kind, level, indent, start, end, first_token, end_token, path, raw, skip_reason) for each block."""
    policy = policy or ChunkPolicy()

    def work(text: str) -> Iterator[tuple]:
        found = blocks(text, scan(text))
        toc = toc_blocks(found) if policy.skip_toc else set()
        for b in found:
            yield b.block, b.kind, b.level, b.indent, b.start, b.end, b.first_token, b.end_token, b.path, b.raw, skip_reason(b, toc, policy)

    return _per_document(docs, work, "block int, kind string, level int, indent int, start int, end int, first_token int, end_token int, path array<int>, raw string, skip_reason string", id_column, text_column)


def container_rows(docs: DataFrame, policy: ChunkPolicy | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, container, kind, members, first_token, end_token, context) for each container."""
    policy = policy or ChunkPolicy()

    def work(text: str) -> Iterator[tuple]:
        for c in containers(blocks(text, scan(text)), policy):
            yield c.container, c.kind, c.members, c.first_token, c.end_token, c.context

    return _per_document(docs, work, "container int, kind string, members array<int>, first_token int, end_token int, context array<int>", id_column, text_column)


def structured_chunk_rows(docs: DataFrame, policy: ChunkPolicy | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, chunk, first_token, end_token, start, end, containers, decision, context_text, chunk_text)."""
    policy = policy or ChunkPolicy()

    def work(text: str) -> Iterator[tuple]:
        tokens = scan(text)
        found = blocks(text, tokens)
        for c in structured_chunks(tokens, containers(found, policy), policy):
            context = ["\n".join(h for k in path if (h := found[k].raw.strip())) for path in c.context]
            yield c.chunk, c.first_token, c.end_token, c.start, c.end, c.containers, c.decision, "\n".join(context) or None, text[c.start : c.end]

    return _per_document(docs, work, "chunk int, first_token int, end_token int, start int, end int, containers array<int>, decision string, context_text string, chunk_text string", id_column, text_column)


def with_previous(chunks: DataFrame, size: int, id_column: str = "doc_id") -> DataFrame:
    """chunks with the last `size` characters of the chunk before, null for the first of a document."""
    before = F.lag("chunk_text").over(Window.partitionBy(id_column).orderBy("chunk"))
    return chunks.withColumn("previous", F.substring(before, F.greatest(F.length(before) - size + 1, F.lit(1)).cast("int"), F.lit(size)))


def batches(chunks: DataFrame, size: int, id_column: str = "doc_id") -> DataFrame:
    """chunks with a batch number: fixed-size batches across documents, in the order of ids (null first) and chunks. They
    are written first, as they are counted, ranked by ranges and numbered."""
    chunks = shared.written(chunks, "chunks")
    counts = chunks.groupBy(id_column).agg(F.count("*").alias("_n"))
    ranked = _running(counts, id_column, "_n").select(F.col(id_column).alias("_id"), "_before")
    place = F.row_number().over(Window.partitionBy(id_column).orderBy("chunk")) - 1
    joined = chunks.withColumn("_place", place).join(ranked, F.col(id_column).eqNullSafe(F.col("_id")))
    return joined.withColumn("batch", F.floor((F.col("_before") + F.col("_place")) / size).cast("int")).drop("_place", "_before", "_id")


def _running(counts: DataFrame, key: str, n: str, most: int = 1_000_000) -> DataFrame:
    """counts with _before, the sum over lesser keys of any type that can be ordered.

    The rows are dealt to ranges of about `most` keys and written; each range is summed by itself, and the sums of the
    ranges alone, one row each, are added up in one task."""
    parts = max(1, -(-counts.count() // most))
    ranged = shared.written(counts.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.sum(n).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(base, "_part")
    return rows.withColumn("_before", F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")
