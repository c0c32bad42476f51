"""Grounding: where in its chunk an extraction stands.

All extractions of a chunk are matched in one sequence alignment, then those left over one by one in the best window.
The alignment is the standard library's longest-block heuristic, whose result depends on all extractions of the chunk,
so a chunk is one unit of work; chunks are short and independent.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from spanloom.operators.tokens import token_spans

EXACT, LESSER, FUZZY = "match_exact", "match_lesser", "match_fuzzy"


@dataclass(frozen=True)
class AlignConfig:
    """delimiter: a symbol that stands in no extraction. threshold: least share of an extraction's tokens found."""

    delimiter: str = "␟"
    fuzzy: bool = True
    threshold: float = 0.75
    accept_lesser: bool = True


@lru_cache(maxsize=10000)
def stem(token: str) -> str:
    low = token.lower()
    return low[:-1] if len(low) > 3 and low.endswith("s") and not low.endswith("ss") else low


def _lowered(text: str) -> list[str]:
    return [text[a:b].lower() for a, b in token_spans(text)]


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) as difflib's get_matching_blocks gives them without junk, but the empty last one.

    Only the tokens of a that b has are looked at, so it takes little for a few tokens in a long text."""
    where: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        where.setdefault(t, []).append(j)
    at = [i for i, t in enumerate(a) if t in where]
    places = [where[a[i]] for i in at]
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        size, besti, bestj, before, last = 0, 0, 0, {}, -2
        for k in range(bisect_left(at, alo), len(at)):
            i = at[k]
            if i >= ahi:
                break
            now = {}
            for j in places[k]:
                if blo <= j < bhi:
                    now[j] = n = (before.get(j - 1, 0) if i == last + 1 else 0) + 1
                    if n > size:
                        size, besti, bestj = n, i - n + 1, j - n + 1
            before, last = now, i
        if size:
            found.append((besti, bestj, size))
            if alo < besti and blo < bestj:
                todo.append((alo, besti, blo, bestj))
            if besti + size < ahi and bestj + size < bhi:
                todo.append((besti + size, ahi, bestj + size, bhi))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def _best_window(source: list[str], wanted: list[str], threshold: float) -> tuple[int, int] | None:
    """The window that holds most of the wanted tokens in order: the smallest such, then the leftmost.

    Windows with the same wanted tokens inside hold as many of them, so of those only the first is looked at."""
    n, need = len(wanted), int(len(wanted) * threshold)
    count: dict[str, int] = {}
    for t in wanted:
        count[t] = count.get(t, 0) + 1
    at = [i for i, t in enumerate(source) if t in count]
    whole: dict[str, int] = {}
    for i in at:
        whole[source[i]] = whole.get(source[i], 0) + 1
    most = sum(min(c, whole.get(t, 0)) for t, c in count.items())  # no window holds more
    if most < need or not at:
        return None
    windows = []
    for x in range(len(at)):
        low, shared, have = (at[x - 1] + 1 if x else 0), 0, {}
        for y in range(x, len(at)):
            t = source[at[y]]
            have[t] = have.get(t, 0) + 1
            shared += have[t] <= count[t]
            high = at[y + 1] if y + 1 < len(at) else len(source)
            size = max(n, at[y] - at[x] + 1)
            if shared >= need and size <= high - low:
                windows.append((size, max(low, at[y] - size + 1), shared))
    best, found, last = 0.0, None, 0
    for size, start, shared in sorted(windows):
        if size > last and best * n >= most:
            break
        last = size
        if shared / n > best:
            score = sum(b[2] for b in matching_blocks(source[start : start + size], wanted)) / n
            if score > best:
                best, found = score, (start, start + size)
    return found if best >= threshold else None


def align(chunk: str, extractions: list[str], config: AlignConfig) -> list[tuple[str | None, int | None, int | None, int | None, int | None]]:
    """Status, first and end token, start and end character of each extraction; all null where it isn't found."""
    spans = token_spans(chunk)
    out: list = [(None,) * 5] * len(extractions)
    low = [chunk[a:b].lower() for a, b in spans]
    words = [_lowered(x) for x in extractions]
    if not low or not any(words):
        return out

    def placed(status: str, a: int, b: int) -> tuple:
        return status, a, b, spans[a][0], spans[b - 1][1]

    begins, joined = {}, []
    for k, x in enumerate(words):
        if config.delimiter in extractions[k]:
            raise ValueError(f"the delimiter is inside an extraction: {extractions[k]!r}")
        if k:
            joined.append(config.delimiter)
        begins.setdefault(len(joined), k)
        if not x and k in begins.values():
            begins[len(joined)] = k
        joined += x
    for a, b, size in matching_blocks(low, joined):
        k = begins.get(b)
        if k is not None and words[k]:
            whole = len(words[k]) == size
            if whole or config.accept_lesser:
                out[k] = placed(EXACT if whole else LESSER, a, a + size)
    if config.fuzzy:
        stems = [stem(w) for w in low]
        for k, x in enumerate(words):
            if out[k][0] is None and x and (window := _best_window(stems, [stem(w) for w in x], config.threshold)):
                out[k] = placed(FUZZY, *window)
    return out


def align_rows(chunks: DataFrame, extractions: DataFrame, config: AlignConfig | None = None, *, keys: tuple[str, ...] = ("doc_id", "chunk")) -> DataFrame:
    """extractions (keys, ord, text) with status, token and character intervals of the document.

    chunks: keys, chunk_text, first_token, start. An extraction that isn't found has nulls; one of a chunk that isn't
    there is dropped, as the join is inner. Chunks without words ground nothing. The extractions go with their chunk in
    one list, and come out of the same call with what was found, so neither side is made twice."""
    config = config or AlignConfig()
    rest = [c for c in extractions.columns if c not in keys and c != "ord"]
    listed = extractions.groupBy(*keys).agg(F.collect_list(F.struct("ord", *rest)).alias("_x"))
    joined = chunks.select(*keys, "chunk_text", "first_token", "start").join(listed, list(keys))
    schema = StructType([chunks.schema[k] for k in keys] + [extractions.schema[c] for c in ("ord", *rest)])
    schema = schema.add("status", StringType())
    for name in ("first_token", "end_token", "start", "end"):
        schema = schema.add(name, LongType())
    first = lambda v: (v is not None, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_x")
            flat = lists.flatten()
            columns = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
            ords, texts, at, done = columns["ord"].to_pylist(), columns["text"].to_pylist(), 0, [(None,) * 5] * len(flat)
            for n, text, token, start in zip(pc.list_value_length(lists).to_pylist(), *(batch.column(c).to_pylist() for c in ("chunk_text", "first_token", "start")), strict=True):
                order = sorted(range(at, at + n), key=lambda k: (*first(ords[k]), *first(texts[k])))
                for k, (status, a, b, s, e) in zip(order, align(text or "", [texts[k] or "" for k in order], config), strict=True):
                    if status is not None:
                        done[k] = (status, a + token, b + token, s + start, e + start)
                at += n
            of = pc.list_parent_indices(lists)
            found = zip(*done, strict=True) if done else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *columns.values(), *(pa.array(v, t) for v, t in zip(found, (pa.string(), *(pa.int64(),) * 4), strict=True))], names=schema.names)

    return joined.mapInArrow(run, schema)
