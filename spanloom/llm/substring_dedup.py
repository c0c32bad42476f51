"""Exact removal of repeated word passages, level by level: windows repeated at one length alone are extended to twice
that length, until the wanted length is reached or no candidate survives.

The wanted length n is reached by lengths that at most double: a quarter of n, half of it, n (9, 18 and 35 words).

* A window of n words is a candidate of a level if its anchor of the level before is repeated: of the shorter windows
  inside it the one of least hash. Equal n-word windows have equal anchors at every level, so no repeat is lost; and only
  anchors, a small part of all places, are counted. Each level counts the anchors of its candidates alone.
* Texts of one word sequence are counted as one text of weight two: a copy repeats as a whole.
* At the last level the candidates themselves are counted, by 128-bit hashes, in hash buckets: each chunk of texts sends
  every distinct window once and gets a bit back for it. Words under a repeated window are removed.

All counts are combined before the shuffle. Anchors that make a thousandth of all rows or more are at most a thousand and
are broadcast, so a passage in a third of all texts makes no large task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.scratch import Scratch, unused

#: Text of one chunk, and distinct windows of one counting bucket; both bound a task's memory, not the data.
CHUNK_BYTES = 1 << 20
BUCKET_WINDOWS = 1 << 20


#: Anchors that make one part in so many of all rows, or more, are hot; so there are no more of them than this.
HOT = 1000


def levels(n: int) -> tuple[int, ...]:
    """The lengths up to n; each is at most twice the one before."""
    return tuple(sorted({-(-n // 4), -(-n // 2), n}))


def _anchors(first: np.ndarray, at: np.ndarray, n: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n-word window within a row: its place, and the hash of its anchor of h words. Arrays over all rows
    together; and the hashes of all h-word windows."""
    gram = W.grams(first, h)
    starts = np.concatenate([np.arange(a, b - n + 1) for a, b in pairwise(at) if b - a >= n] or [np.empty(0, dtype=np.int64)])
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64), gram
    least, width, span = gram, 1, n - h + 1
    while 2 * width <= span:  # the minimum over `span` places, by doubling
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return starts, least[starts], gram


def _distinct_anchors(starts: np.ndarray, window: np.ndarray, gram: np.ndarray, at: np.ndarray, h: int) -> pa.ListArray:
    """The distinct anchors of each row's windows; one that is at two places of its row is given twice."""
    bounds, anchors = np.searchsorted(starts, at), []
    for k, (a, b) in enumerate(pairwise(bounds)):
        own = np.unique(window[a:b])
        if len(own):
            inside, times = np.unique(gram[at[k] : at[k + 1] - h + 1], return_counts=True)
            own = np.concatenate([own, own[np.isin(own, inside[times > 1], assume_unique=True)]])
        anchors.append(own)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in anchors])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), W.signed(np.concatenate([gram[:0], *anchors])))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first_level(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = levels(n)[0]
        for batch in batches:
            for part in W.slices(batch, most=CHUNK_BYTES):
                flat, at = W.split(part["text"])
                first, second = W.hashes(flat)
                high, low = W.whole(first, at), W.whole(second, at)
                starts, window, gram = _anchors(first, at, n, h)
                listed = flat.cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        part["tag"],
                        pa.array(np.diff(at)),
                        W.signed(high),
                        W.signed(low),
                        pa.array([_sha(listed[a:b]) for a, b in pairwise(at)]),
                        _distinct_anchors(starts, window, gram, at, h),
                    ],
                    names=["id", "tag", "n_words", "high", "low", "sha", "anchors"],
                )

    return run


def _repeated(starts: np.ndarray, anchor: np.ndarray, at: np.ndarray, anchors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Which windows have an anchor that is among their row's repeated ones."""
    bounds, keep = np.searchsorted(starts, at), np.zeros(len(starts), dtype=bool)
    for k, (a, b) in enumerate(pairwise(bounds)):
        if b > a:
            keep[a:b] = np.isin(anchor[a:b], np.asarray(anchors[k].values).view(np.uint64))
    return keep


def _next_level(n: int, before: int, h: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The anchors of h words of the windows whose anchor of `before` words is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "squeezed", CHUNK_BYTES // 2):
                flat, at = W.split(W.unsqueezed(part["squeezed"]))
                first, _ = W.hashes(flat)
                starts, anchor, _ = _anchors(first, at, n, before)
                keep = _repeated(starts, anchor, at, part["anchors"])
                _, window, gram = _anchors(first, at, n, h)
                new = _distinct_anchors(starts[keep], window[keep], gram, at, h)
                yield pa.RecordBatch.from_arrays([new if c == "anchors" else part[c] for c in _TEXT], names=list(_TEXT))

    return run


def _candidates(text: pa.Array, anchors: pa.Array | pa.ChunkedArray, n: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """n-word windows whose anchor of h words is repeated: places, both hashes; and the row bounds and words."""
    flat, at = W.split(text)
    first, second = W.hashes(flat)
    starts, anchor, _ = _anchors(first, at, n, h)
    starts = starts[_repeated(starts, anchor, at, anchors)]
    return starts, W.grams(first, n)[starts] if len(starts) else first[:0], W.grams(second, n)[starts] if len(starts) else first[:0], at, flat


#: Columns of a text on its way through the levels; anchors: the repeated ones of the last level.
_TEXT = ("id", "high", "low", "squeezed", "anchors", "copied")
_TEXT_SCHEMA = "id long, high long, low long, squeezed binary, anchors array<long>, copied boolean"


_PAIR = np.dtype([("x", "<u8"), ("y", "<u8")])


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, each place's pair, and whether a pair is there more than once."""
    order = np.lexsort((y, x))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    pairs = np.empty(int(new.sum()), dtype=_PAIR)
    pairs["x"], pairs["y"] = x[order][new], y[order][new]
    return pairs, number, np.bincount(number, minlength=len(pairs)) > 1


def _by_bucket(x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted hashes: the buckets that have any, and where each begins and ends."""
    bucket = (x >> np.uint64(33)).astype(np.int64) * buckets >> 31
    some, begin = np.unique(bucket, return_index=True)
    return some, begin, np.append(begin[1:], len(x))


def _last_level(n: int, h: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: the texts of a chunk, and for each bucket the chunk's distinct windows."""
    own_kinds = {"id": pa.int64(), "high": pa.int64(), "low": pa.int64(), "squeezed": pa.binary(), "anchors": pa.list_(pa.int64()), "copied": pa.bool_()}
    kinds = {"chunk": pa.string(), **own_kinds, "bucket": pa.int32(), "windows": pa.binary(), "twice": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "squeezed", CHUNK_BYTES // 2):
                order = pc.sort_indices(pa.Table.from_batches([part]), sort_keys=[("id", "ascending"), ("high", "ascending"), ("low", "ascending")])
                part = pa.Table.from_batches([part]).take(order).combine_chunks().to_batches()[0]
                name = hashlib.sha256(b"".join(np.asarray(part[c].fill_null(0)).tobytes() for c in ("id", "high", "low"))).hexdigest()[:32]
                rows = {c: part[c] for c in _TEXT}
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows) if c == "chunk" else rows.get(c, pa.nulls(part.num_rows, t)) for c, t in kinds.items()], names=list(kinds))
                starts, x, y, at, _ = _candidates(W.unsqueezed(part["squeezed"]), part["anchors"], n, h)
                if not len(starts):
                    continue
                pairs, number, twice = _distinct(x, y)
                copied = np.repeat(np.asarray(part["copied"].fill_null(False)), np.diff(at))[starts]
                twice |= np.bincount(number, weights=copied, minlength=len(pairs)) > 0
                full, begin, end = _by_bucket(pairs["x"], buckets)
                own = {
                    "chunk": pa.array([name] * len(full)),
                    "bucket": pa.array(full, type=pa.int32()),
                    "windows": pa.array([pairs[a:b].tobytes() for a, b in zip(begin, end, strict=True)], type=pa.binary()),
                    "twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(begin, end, strict=True)], type=pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(full), t)) for c, t in kinds.items()], names=list(kinds))

    return run


def _count(rows: pa.Table) -> pa.Table:
    """For each chunk of one bucket a bit for each of its windows: is it anywhere else, or twice in its chunk?"""
    held = [np.frombuffer(x.as_buffer(), dtype=_PAIR) for x in rows["windows"]]
    every = np.concatenate(held)
    _, number, again = _distinct(every["x"], every["y"])
    flags, at, out = again[number], 0, []
    for own, bits in zip(held, rows["twice"], strict=True):
        inside = np.unpackbits(np.frombuffer(bits.as_buffer(), dtype=np.uint8), count=len(own)).astype(bool)
        out.append(np.packbits(flags[at : at + len(own)] | inside).tobytes())
        at += len(own)
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "repeated": pa.array(out, type=pa.binary())})


def _cover(n: int, h: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The words left of each text of a chunk."""

    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"high": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "spans": pa.array([], pa.list_(pa.int32()))})
        texts = texts.sort_by([("id", "ascending"), ("high", "ascending"), ("low", "ascending")]).combine_chunks()
        starts, x, y, at, flat = _candidates(W.unsqueezed(texts["squeezed"]), texts["anchors"].combine_chunks(), n, h)
        covered = np.zeros(len(flat) + 1, dtype=np.int64)
        if len(starts):
            pairs, number, _ = _distinct(x, y)
            place = {k: (a, b) for k, a, b in zip(*(x.tolist() for x in _by_bucket(pairs["x"], buckets)), strict=True)}
            repeated = np.zeros(len(pairs), dtype=bool)
            for k, packed in zip(bits["bucket"].to_pylist(), bits["repeated"], strict=True):
                a, b = place[k]
                repeated[a:b] = np.unpackbits(np.frombuffer(packed.as_buffer(), dtype=np.uint8), count=b - a)
            hit = starts[repeated[number]]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + n, -1)
        gone = np.cumsum(covered)[:-1] > 0
        listed, kept, spans = flat.cast(pa.binary()).to_pylist(), [], []
        for a, b in pairwise(at):
            kept.append(b" ".join(w for w, g in zip(listed[a:b], gone[a:b].tolist(), strict=True) if not g).decode())
            spans.append(np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).tolist())
        counts = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({"high": texts["high"], "low": texts["low"], "n_removed": pa.array(counts[at[1:]] - counts[at[:-1]]), "kept_text": pa.array(kept), "spans": pa.array(spans, type=pa.list_(pa.int32()))})

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the SHA-256 of kept_text and leaves that out."""
    for batch in batches:
        shas = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch["kept_text"].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["high"], batch["low"], batch["n_removed"], pa.array(shas, type=pa.string())], names=["high", "low", "n_removed", "sha"])


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and text, and a tag that tells rows of one id (or none) and several texts apart."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def _survivors(placed: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(keys..., anchors): the anchors of each text that are repeated; texts without any go. placed: keys, copied, anchor.

    Hot anchors are marked in place; the others meet their counts by a join in which none makes a thousandth of the
    rows."""
    counted = placed.groupBy("anchor").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n"), F.count("*").alias("rows"))
    counted = scratch.put(counted.where("n > 1"), f"{name}-counts")
    rows = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") * HOT >= F.lit(rows)
    few = F.broadcast(counted.where(hot).select("anchor"))  # at most HOT rows
    own = placed.select(*keys, "anchor")
    rest = own.join(few, "anchor", "left_anti").join(counted.where(~hot).select("anchor").hint("merge"), "anchor")
    found = own.join(few, "anchor").unionByName(rest)
    return scratch.put(found.groupBy(*keys).agg(F.collect_set("anchor").alias("anchors")), name)


def _repeats(texts: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-level rows, word sequences that more than one row has (and whether they are hot), and texts with removed
    words."""
    lengths = levels(n)
    level = scratch.put(texts.mapInArrow(_first_level(n), "id long, tag long, n_words long, high long, low long, sha string, anchors array<long>"), "level-0")
    classes = level.where(F.col("n_words") >= n).groupBy("high", "low").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("of"), F.count("*").alias("n"))
    classes = scratch.put(classes.select("high", "low", F.col("of.id").alias("node"), F.col("of.tag").alias("node_tag"), (F.col("n") > 1).alias("copied"), "n"), "classes")
    hot = F.col("n") * HOT >= F.lit(level.count())  # at most HOT classes
    copies = classes.where("copied").select("high", "low", hot.alias("hot"))
    classes = classes.drop("n")
    # one row stands for its class
    chosen = level.where(F.col("n_words") >= n).select("id", "tag", F.col("high").alias("p"), F.col("low").alias("q"), "anchors")
    ours = chosen.join(classes, (F.col("p") == F.col("high")) & (F.col("q") == F.col("low")) & F.col("id").eqNullSafe(F.col("node")) & (F.col("tag") == F.col("node_tag")))
    placed = ours.select("id", "tag", "high", "low", "copied", F.explode("anchors").alias("anchor"))
    survivors = _survivors(placed, ["id", "tag", "high", "low", "copied"], scratch, "survivors-0")
    squeezed = texts.mapInArrow(W.squeeze, "id long, tag long, squeezed binary").select(F.col("id").alias("own"), F.col("tag").alias("own_tag"), "squeezed")
    alive = squeezed.join(survivors.hint("merge"), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag"))).select(*_TEXT)
    used, tables = lengths[0], ["level-1", "survivors-0", "survivors-0-counts"]
    for k, (before, h) in enumerate(pairwise(lengths[:-1]), 1):
        if survivors.isEmpty():
            break
        deeper = scratch.put(alive.mapInArrow(_next_level(n, before, h), _TEXT_SCHEMA), f"level-{k}")
        placed = deeper.select("high", "low", "copied", F.explode("anchors").alias("anchor"))
        survivors, used = _survivors(placed, ["high", "low"], scratch, f"survivors-{k}"), h
        alive = deeper.drop("anchors").join(survivors, ["high", "low"]).select(*_TEXT)
        tables += [f"level-{k}", f"survivors-{k}", f"survivors-{k}-counts"]
    cut_schema = "high long, low long, n_removed long, kept_text string, spans array<int>"
    if survivors.isEmpty():
        return level, copies, texts.sparkSession.createDataFrame([], cut_schema)

    size = survivors.agg(F.sum(F.size("anchors"))).first()[0]
    buckets = max(1, -(-size * (n - used + 1) // 2 // BUCKET_WINDOWS))
    kinds = f"chunk string, {_TEXT_SCHEMA}, bucket int, windows binary, twice binary"
    last = scratch.put(alive.mapInArrow(_last_level(n, used, buckets), kinds), "last")
    bits = last.where("bucket IS NOT NULL").select("chunk", "bucket", "windows", "twice").groupBy("bucket").applyInArrow(_count, "chunk string, bucket int, repeated binary")
    chunks = last.where("bucket IS NULL").select("chunk", *_TEXT)
    cut = chunks.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(_cover(n, used, buckets), cut_schema)
    scratch.drop(*tables)
    return level, copies, cut.where("n_removed > 0")


def removed(docs: DataFrame, window: int = 35, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of docs.

    A word is a run of anything but ASCII white space, taken unchanged. Words under a window of `window` consecutive
    words are removed when the same word sequence also starts anywhere else, in the same row or another; all windows
    are judged on the input. kept_sha256 is over the words left, joined by one space.

    Nulls: a null text has no words; a null id is a row like others. Repeated rows repeat each other's windows. Texts of
    fewer words than a window lose nothing. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    texts = _texts(docs, id_column, text_column)
    level, copies, cut = _repeats(texts, window, scratch)
    some = scratch.put(cut.select("high", "low", "n_removed", "kept_text").mapInArrow(_plain, "high long, low long, n_removed long, sha string"), "cut").dropDuplicates(["high", "low"])
    scratch.drop("last")
    rows = level.select("id", "n_words", "high", "low", F.col("sha").alias("own"))
    whole = lambda hot: copies.where("hot" if hot else "NOT hot").select("high", "low", F.lit(True).alias("whole"))
    # rows of a hot class, which lose all, are marked in place; all others meet what is known of their class
    full = rows.join(F.broadcast(whole(True)), ["high", "low"]).withColumn("n_removed", F.col("n_words")).withColumn("sha", F.lit(None).cast("string"))
    rest = rows.join(F.broadcast(whole(True)), ["high", "low"], "left_anti").join(whole(False), ["high", "low"], "left").join(some, ["high", "low"], "left")
    return full.unionByName(rest).select(
        F.col("id").alias(id_column),
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, window: int = 35, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the text left after removal; texts that lose nothing stay exactly as they are.

    Rows of one word sequence that are copies of each other lose all of it. A text left without words is an empty one.
    A null text stays null, null ids are rows like others, repeated rows lose what they repeat; other columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    texts = _texts(docs, id_column, text_column)
    level, copies, cut = _repeats(texts, window, scratch)
    changed = scratch.put(cut.select("high", "low", "kept_text"), "cut").dropDuplicates(["high", "low"])
    scratch.drop("last")
    rows = level.select("id", "tag", "high", "low")
    whole = lambda hot: copies.where("hot" if hot else "NOT hot").select("high", "low", F.lit("").alias("emptied"))
    full = rows.join(F.broadcast(whole(True)), ["high", "low"]).withColumn("kept_text", F.lit(None).cast("string"))
    rest = rows.join(F.broadcast(whole(True)), ["high", "low"], "left_anti").join(whole(False), ["high", "low"], "left").join(changed, ["high", "low"], "left")
    news = full.unionByName(rest).where("emptied IS NOT NULL OR kept_text IS NOT NULL")
    own, tag, new = (unused(docs.columns, c) for c in ("_id", "_tag", "_new"))
    news = news.select(F.col("id").alias(own), F.col("tag").alias(tag), F.coalesce("emptied", "kept_text").alias(new)).dropDuplicates([own, tag])
    same = F.col(id_column).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_column).cast("string")) == F.col(tag))
    return docs.join(news, same, "left").withColumn(text_column, F.coalesce(new, text_column)).drop(own, tag, new)
