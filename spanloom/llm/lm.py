"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark.

The vocabulary is a sorted array of 64-bit word hashes; a word's number is its place there. A bigram's key is the number
of its context times the number of words, plus the number of its word: a hash without collisions. Vocabulary, bigram
keys with counts, context sums and continuation counts are sorted arrays in the shared folder, split into buckets, and
workers map them into memory to score. Counting sends each distinct word or bigram of a task once, packed by bucket, so
no word, however frequent, makes a large task; only a few sums of each bucket come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import ngram_store as store
from spanloom.llm import words as W
from spanloom.llm.scratch import Scratch

#: The hash of the end token. A line feed is in no word.
END = np.frombuffer(xxhash.xxh3_128_digest(b"\n"), dtype="<u8")[0]
#: Distinct entries that a task holds before it sends them, and text that it works on at a time.
HELD = 3 << 20
TEXT = 8 << 20
#: Bytes of training text for each bucket of the model at most on average, however few the session's partitions are.
BUCKET_TEXT = 16 << 20


def _packed(numbers: np.ndarray) -> bytes:
    """Small integers in few bytes: bytes of one weight together, then compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _sent(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its keys (as differences) and their counts."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, dtype=np.int64)
    ends = [*starts[1:], len(bucket)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[starts].astype(np.int32)),
            pa.array([_packed(np.diff(keys[a:b], prepend=keys.dtype.type(0))) for a, b in zip(starts, ends, strict=False)], type=pa.binary()),
            pa.array([_packed(counts[a:b]) for a, b in zip(starts, ends, strict=False)], type=pa.binary()),
        ],
        names=["bucket", "keys", "counts"],
    )


_SENT = "bucket int, keys binary, counts binary"


def _received(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in rows["keys"].to_pylist()]
    counts = [_unpacked(x) for x in rows["counts"].to_pylist()]
    return _summed(np.concatenate(keys), np.concatenate(counts))


class _Held:
    """Counts of a task, sent when there are many."""

    def __init__(self, bucket: Callable[[np.ndarray], np.ndarray]) -> None:
        self.bucket, self.parts, self.size = bucket, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.unique(keys, return_counts=True)
        self.parts.append((own[0].astype(np.uint64), own[1].astype(np.uint64)))
        self.size += len(own[0])
        if self.size > HELD:
            self._merge()
            if self.size > HELD // 2:
                yield from self.flush()

    def _merge(self) -> None:
        self.parts = [_summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))] if self.parts else []
        self.size = len(self.parts[0][0]) if self.parts else 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.size:
            keys, counts = self.parts[0]
            yield _sent(keys, counts, self.bucket(keys))
        self.parts, self.size = [], 0


def _parted(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and the places where it does."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]), strict=True) if len(found) else iter(())


def _by_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and where each text's begin."""
    flat, at = W.split(text, lower=True)
    first, _ = W.hashes(flat)
    n = np.diff(at)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(bounds[-1]), END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = first
    return out, bounds


def _count_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(lambda keys: _by_hash(keys, buckets))
        for batch in batches:
            for part in W.slices(batch, most=TEXT):
                yield from held.add(_tokens(part["text"])[0])
        yield from held.flush()

    return run


def _keep_words(root: str) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _received(rows)
        bucket = rows["bucket"][0].as_py()
        store.save(keys.astype("<u8"), f"{root}/words-{bucket}")
        store.save(counts.astype("<u8"), f"{root}/word-counts-{bucket}")
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Where the words are: buckets by hash, and the number of the first word of each."""

    root: str
    buckets: int
    first: tuple[int, ...]
    size: int
    tokens: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the count of each word; -1 and 0 for unknown ones."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for b, own in _parted(_by_hash(hashes, self.buckets)):
            words = store.load(f"{self.root}/words-{b}", "<u8")
            if len(words):
                at = np.minimum(np.searchsorted(words, hashes[own]), len(words) - 1)
                known = words[at] == hashes[own]
                number[own] = np.where(known, at + self.first[b], -1)
                count[own] = np.where(known, store.load(f"{self.root}/word-counts-{b}", "<u8")[at], 0)
        return number, count

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As find, for hashes in any order."""
        distinct, place = np.unique(hashes, return_inverse=True)
        number, count = self.find(distinct)
        return number[place], count[place]


def _pairs(number: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """The number of the token before each, `begin` before the first of a text."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[at[:-1]] = begin
    return before


def _bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """Contexts are spread by a hash; all bigrams of a context are in one bucket."""
    mixed = W.mix(context.astype(np.uint64), np.full(len(context), 3, dtype=np.uint64))
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _count_bigrams(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64(vocabulary.size)
        held = _Held(lambda keys: _bucket_of(keys // width, vocabulary.buckets))
        for batch in batches:
            for part in W.slices(batch, most=TEXT):
                token, at = _tokens(part["text"])
                number, _ = vocabulary.numbers(token)
                yield from held.add(_pairs(number, at, vocabulary.size).astype(np.uint64) * width + number.astype(np.uint64))
        yield from held.flush()

    return run


def _keep_bigrams(vocabulary: Vocabulary) -> Callable[[pa.Table], pa.Table]:
    """Writes a bucket's arrays; gives the continuations of its words, and counts of counts."""

    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _received(rows)
        bucket, size = rows["bucket"][0].as_py(), np.uint64(vocabulary.size)
        context, word = keys // size, keys % size
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
        store.save(keys.astype("<u8"), f"{vocabulary.root}/bigrams-{bucket}")
        store.save(counts.astype("<u4"), f"{vocabulary.root}/bigram-counts-{bucket}")
        store.save(context[starts].astype("<u8"), f"{vocabulary.root}/contexts-{bucket}")
        store.save(sums.astype("<i8"), f"{vocabulary.root}/context-sums-{bucket}")
        followed, times = np.unique(word, return_counts=True)
        sent = _sent(followed, times.astype(np.uint64), (followed * np.uint64(vocabulary.buckets) // size).astype(np.int64))
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        n = sent.num_rows
        return pa.table({"bucket": sent["bucket"], "keys": sent["keys"], "counts": sent["counts"], "from": pa.array([bucket] * n, pa.int32()), "of": pa.array([of] * n, pa.list_(pa.int64()))})

    return run


def _keep_continuations(vocabulary: Vocabulary) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _received(rows)
        bucket = rows["bucket"][0].as_py()
        store.save(keys.astype("<u8"), f"{vocabulary.root}/followers-{bucket}")
        store.save(counts.astype("<u8"), f"{vocabulary.root}/follower-counts-{bucket}")
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "total": pa.array([int(counts.sum())], pa.int64()), "more": pa.array([int((counts >= 3).sum())], pa.int64()), "of": pa.array([of], pa.list_(pa.int64()))})

    return run


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur 1, 2, 3 and 4 times. Where a number is
    missing, what it would give is taken as the plain discount."""
    n1, n2, n3, n4 = of
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the mapped arrays."""

    vocabulary: Vocabulary
    bigram: tuple[float, float, float]
    unigram: tuple[float, float, float]
    types: int
    left: float

    def unigrams(self, number: np.ndarray) -> np.ndarray:
        """The probability of each word by its continuations, down to a uniform share for unknown ones."""
        v = self.vocabulary
        out = np.full(len(number), (self.left if self.types else 1.0) / (v.size + 1))
        known = np.flatnonzero(number >= 0)
        for b, at in _parted(number[known] * v.buckets // max(v.size, 1)):
            own = known[at]
            words, counts = store.load(f"{v.root}/followers-{b}", "<u8"), store.load(f"{v.root}/follower-counts-{b}", "<u8")
            at = np.minimum(np.searchsorted(words, number[own].astype(np.uint64)), len(words) - 1)
            times = np.where(words[at] == number[own], counts[at], 0).astype(np.float64)
            out[own] += np.maximum(times - np.array((0.0, *self.unigram))[np.minimum(times, 3).astype(np.int64)], 0) / self.types
        return out

    def log10(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        """log10 p(word | word before) of each pair; -1: unknown."""
        v = self.vocabulary
        words, place = np.unique(number, return_inverse=True)
        lower = self.unigrams(words)[place]
        contexts, context = np.unique(before, return_inverse=True)
        sums = np.zeros((len(contexts), 4))
        some = np.flatnonzero(contexts >= 0)
        for b, at in _parted(_bucket_of(contexts[some], v.buckets)):
            own = some[at]
            held = store.load(f"{v.root}/contexts-{b}", "<u8")
            if len(held):
                at = np.minimum(np.searchsorted(held, contexts[own].astype(np.uint64)), len(held) - 1)
                sums[own] = np.where((held[at] == contexts[own])[:, None], store.load(f"{v.root}/context-sums-{b}", "<i8").reshape(-1, 4)[at], 0)
        keys = np.where((before >= 0) & (number >= 0), before * v.size + number, -1)
        distinct, of = np.unique(keys, return_inverse=True)
        times = np.zeros(len(distinct))
        live = np.flatnonzero(distinct >= 0)
        for b, place in _parted(_bucket_of(distinct[live] // max(v.size, 1), v.buckets)):
            own = live[place]
            held = store.load(f"{v.root}/bigrams-{b}", "<u8")
            if len(held):
                at = np.minimum(np.searchsorted(held, distinct[own].astype(np.uint64)), len(held) - 1)
                times[own] = np.where(held[at] == distinct[own], store.load(f"{v.root}/bigram-counts-{b}", "<u4")[at], 0)
        times = times[of]
        total = sums[context, 0]
        some = total > 0
        share = np.divide(np.maximum(times - np.array((0.0, *self.bigram))[np.minimum(times, 3).astype(np.int64)], 0), total, out=np.zeros(len(total)), where=some)
        back = np.divide(sums[context, 1:] @ np.array(self.bigram), total, out=np.ones(len(total)), where=some)
        return np.log10(share + back * lower)


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.vocabulary
        for batch in batches:
            for part in W.slices(batch, most=TEXT):
                token, at = _tokens(part["text"])
                number, count = v.numbers(token)
                base = np.log10((count + 0.1) / (v.tokens + 0.1 * (v.size + 1)))
                own = model.log10(_pairs(number, at, v.size), number)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["held_out"], pa.array(np.diff(at)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at[:-1])), pa.array(np.full(part.num_rows, v.tokens)), pa.array(np.add.reduceat(base, at[:-1])), pa.array(np.add.reduceat(own, at[:-1]))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def fit(texts: DataFrame, scratch: Scratch) -> Model:
    """A model of all texts. Buckets: as many as Spark's shuffle partitions, more where each would stand for more than
    BUCKET_TEXT bytes of text; each bucket is a task of its own."""
    length = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-length // BUCKET_TEXT))
    root = scratch.path("model")
    dealt = lambda sent: sent.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    words = dealt(texts.select("text").mapInArrow(_count_words(buckets), _SENT)).applyInArrow(_keep_words(root), "bucket int, words long, tokens long").collect()
    sizes = [0] * buckets
    for r in words:
        sizes[r["bucket"]] = r["words"]
    vocabulary = Vocabulary(root, buckets, tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)[:-1]])), sum(sizes), sum(r["tokens"] for r in words))
    if not vocabulary.size:
        return Model(vocabulary, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), 0, 1.0)
    kept = dealt(texts.select("text").mapInArrow(_count_bigrams(vocabulary), _SENT)).applyInArrow(_keep_bigrams(vocabulary), f"{_SENT}, from int, of array<long>")
    kept = scratch.put(kept, "continuations")
    of = kept.groupBy("from").agg(F.first("of").alias("of")).agg(*(F.sum(F.col("of")[k]) for k in range(4))).first()
    ends = dealt(kept.select("bucket", "keys", "counts")).applyInArrow(_keep_continuations(vocabulary), "bucket int, total long, more long, of array<long>").collect()
    scratch.drop("continuations")
    types, once = sum(r["total"] for r in ends), [sum(r["of"][k] for r in ends) for k in range(4)]
    unigram = discounts(once)
    left = (unigram[0] * once[0] + unigram[1] * once[1] + unigram[2] * sum(r["more"] for r in ends)) / types
    return Model(vocabulary, discounts(list(of)), unigram, types, left)


def scores(docs: DataFrame, held_out: F.Column | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are words in lower case (A-Z) between ASCII white space, and one end. The model learns from the rows that
    aren't held out (default: the CRC-32 of the id as text is divisible by 10) and scores all. score and base_score are
    log10 probabilities of the whole text by the bigram model and by add-0.1 unigrams; a perplexity is
    10 ** (-score / n_tokens).

    Nulls: a null text is an empty one, just an end; a null id isn't held out. Repeated rows count again. Other columns
    are ignored; an empty table gives an empty one; if no row is left to learn from, every token is unknown.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    key = F.col(id_column)
    out = held_out if held_out is not None else F.crc32(key.cast("string").cast("binary")) % 10 == 0
    rows = docs.select(key.alias("id"), F.coalesce(out, F.lit(False)).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    model = fit(rows.where(~F.col("held_out")), scratch)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_column)


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / tokens)
