"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A fingerprint is the sorted set of a text's spot signatures, eight hex digits each; likeness is the Jaccard similarity
of two such sets. Two sets can only be as alike as their sizes, so the comparison of many texts is partitioned by set
size and pruned before any set is intersected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.quality import COMMON
from spanloom.llm.scratch import Scratch


@dataclass(frozen=True)
class SpotConfig:
    """anchors: common words. chain: content words of a spot. distance: from one content word of it to the next."""

    anchors: frozenset[str] = COMMON
    chain: int = 2
    distance: int = 1


def spots(text: pa.Array, config: SpotConfig) -> list[np.ndarray]:
    """For each text its sorted distinct spot signatures (32 bits).

    Words are compared in lower case without punctuation around them. A text with words but no spot has one signature,
    that of its whole word sequence; a text without words has none."""
    flat, at = W.split(text)
    coded = flat.dictionary_encode()
    bare = [w.lower().strip(".,;:!?\"'()[]«»“”„") for w in coded.dictionary.to_pylist()]
    code = np.asarray(coded.indices, dtype=np.int64)
    value = W.hashes(pa.array(bare, type=pa.string()))[0][code] if bare else np.empty(0, dtype=np.uint64)
    anchor = np.array([w in config.anchors for w in bare], dtype=bool)[code] if bare else np.empty(0, dtype=bool)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    content, places = np.flatnonzero(~anchor), np.flatnonzero(anchor)
    first = np.searchsorted(content, places, side="right")
    last = first + (config.chain - 1) * config.distance
    inside = last < len(content)
    places, first, last = places[inside], first[inside], last[inside]
    inside = row[content[last]] == row[places]
    places, first = places[inside], first[inside]
    signature = value[places]
    for k in range(config.chain):
        signature = W.mix(signature, value[content[first + k * config.distance]])
    short, owner = (signature >> np.uint64(32)).astype(np.uint32), row[places]
    cut = np.searchsorted(owner, np.arange(len(at)))
    sequence = (W.whole(value, at) >> np.uint64(32)).astype(np.uint32)
    return [np.unique(short[a:b]) if b > a else sequence[k : k + 1] if at[k + 1] > at[k] else short[:0] for k, (a, b) in enumerate(pairwise(cut))]


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without looking inside when their sizes alone put it under `least`.
    Two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _hex(spot: np.ndarray) -> str:
    return spot.astype(">u4").tobytes().hex()


def _set(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down) gives way to as much of the beginning of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_KINDS = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("tag", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_SCHEMA = "kind string, id long, tag long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _rows(ids: list, tags: list, texts: list[str], sets: list[np.ndarray], following: list[str], next_sets: list[np.ndarray], config: SpotConfig) -> pa.RecordBatch:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = spots(pa.array(new, type=pa.string()), config)
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["row"] * n, type=pa.string()),
            pa.array(ids, type=pa.int64()),
            pa.array(tags, type=pa.int64()),
            pa.array([len(t) for t in texts], type=pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], type=pa.string()),
            pa.array([_hex(s) for s in sets], type=pa.string()),
            pa.array([_hex(s) for s in other], type=pa.string()),
            pa.array([likeness(a, b) for a, b in zip(sets, other, strict=True)], type=pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(sets, next_sets, strict=True)], type=pa.float64()),
            pa.nulls(n, pa.string()),
        ],
        schema=_KINDS,
    )


def _loose(kind: str, one: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": kind, "id": one[0], "tag": one[1], "text": one[2]}], schema=_KINDS)


def _walk(config: SpotConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over the sorted rows of a partition. Its first and its last row are also given with their texts: the row that
    follows the last one is in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in W.slices(batch, "squeezed", W.SLICE_BYTES // 2):
                text = W.unsqueezed(part["squeezed"])
                now = list(zip(part["id"].to_pylist(), part["tag"].to_pylist(), text.to_pylist(), spots(text, config), strict=True))
                if held is None:
                    yield _loose("first", now[0])
                else:
                    now.insert(0, held)
                held = now[-1]
                if len(now) > 1:
                    ids, tags, texts, sets = (list(x) for x in zip(*now[:-1], strict=True))
                    yield _rows(ids, tags, texts, sets, [x[2] for x in now[1:]], [x[3] for x in now[1:]], config)
        if held is not None:
            yield _loose("last", held)

    return run


def _join_ends(config: SpotConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over the sorted ends of all partitions: each last row is followed by the next first one, the very last by the
    very first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = held = None

        def row(one: tuple, after: str) -> pa.RecordBatch:
            both = spots(pa.array([one[2], after], type=pa.string()), config)
            return _rows([one[0]], [one[1]], [one[2]], both[:1], [after], both[1:], config)

        for batch in batches:
            for kind, *one in zip(*(batch[c].to_pylist() for c in ("kind", "id", "tag", "text")), strict=True):
                if kind == "last":
                    held = one
                else:
                    start = one if start is None else start
                    if held is not None:
                        yield row(held, one[2])
        if held is not None:
            yield row(held, start[2])

    return run


def fingerprints(docs: DataFrame, config: SpotConfig | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The rows are put in order by ranges of ids, and each partition is walked once; only the two ends of each partition
    meet in one task, so that is bounded by the number of partitions. A text's edited form borrows from the text of the
    next id, the last id's from the first.

    Nulls: a null text is an empty one; null ids come first. Rows of one id are in order of a hash of their texts. Other
    columns are ignored; an empty table gives an empty one; a single row follows itself.
    """
    config = config or SpotConfig()
    scratch = Scratch(docs.sparkSession, "spotsigs")
    text = F.col(text_column).cast("string")
    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(W.squeeze, "id long, tag long, squeezed binary").repartitionByRange("id", "tag").sortWithinPartitions("id", "tag")
    walked = scratch.put(ordered.mapInArrow(_walk(config), _SCHEMA), "walked")
    ends = walked.where("kind <> 'row'").select("kind", "id", "tag", "text").repartition(1).sortWithinPartitions("id", "tag", "kind")
    rows = walked.where("kind = 'row'").unionByName(ends.mapInArrow(_join_ends(config), _SCHEMA))
    return rows.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compare(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [likeness(_set(a), _set(b), least) for a, b in zip(batch["fp_a"].to_pylist(), batch["fp_b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(like, type=pa.float64())], names=["a", "b", "likeness"])

    return run


def similar_pairs(prints: DataFrame, least: float = 0.8, *, id_column: str = "doc_id") -> DataFrame:
    """(a, b, likeness) for each pair of fingerprint classes that are alike, a and b being the classes' least ids.

    prints: the id and fingerprint columns of `fingerprints`. Equal fingerprints are one class, so copies aren't paired.
    Candidates share one of their rarest signatures, of as many as `least` leaves room for, and are of sizes within
    `least` of each other: only neighbouring size partitions meet. Null ids and empty fingerprints pair with nothing.
    """
    classes = prints.where(F.col(id_column).isNotNull() & (F.length("fingerprint") > 0)).groupBy("fingerprint").agg(F.min(id_column).alias("id"))
    size = (F.length("fingerprint") / 8).cast("int")
    spot = F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.substring(F.col("fingerprint"), k * 8 + 1, F.lit(8))))
    each = classes.withColumn("size", size).select("id", "size", spot.alias("spot"))
    ranked = each.join(each.groupBy("spot").agg(F.count("*").alias("n")), "spot").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "spot"))).alias("rare"))
    prefix = ranked.select("id", "size", F.explode(F.slice("rare", 1, F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9).cast("int") + 1)).alias("x")).select("id", "size", F.col("x.spot").alias("spot"))
    # partitions by size: sizes of one partition and the next cover all that `least` allows
    level = lambda c: F.floor(F.log(c.cast("double")) / F.lit(-float(np.log(least))) + 1e-9).cast("int")
    left = prefix.withColumn("part", level(F.col("size"))).select(F.col("id").alias("a"), F.col("size").alias("size_a"), "spot", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.withColumn("part", level(F.col("size"))).select(F.col("id").alias("b"), F.col("size").alias("size_b"), "spot", "part")
    met = left.join(right, ["spot", "part"]).where((F.col("a") != F.col("b")) & (F.least("size_a", "size_b") >= F.lit(least) * F.greatest("size_a", "size_b") - 1e-9))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = classes.select("id", "fingerprint")
    both = met.join(of.withColumnsRenamed({"id": "a", "fingerprint": "fp_a"}), "a").join(of.withColumnsRenamed({"id": "b", "fingerprint": "fp_b"}), "b")
    return both.select("a", "b", "fp_a", "fp_b").mapInArrow(_compare(least), "a long, b long, likeness double").where(F.col("likeness") >= least)
