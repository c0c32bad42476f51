"""Whole-batch word splitting and n-gram hashing on Arrow data.

A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return. Nothing here
loops over words in Python; Python only sees each distinct word of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Text that is worked on at a time, in bytes; it bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 2 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` bytes of text each; a longer text is a part of its own."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def split(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all rows, and where each row's words begin (one more entry than rows). A null has no words."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    words, at = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    at = at - at[0]
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():
        words, at = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at]
    return words, at.astype(np.int64)


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    coded = words.dictionary_encode()
    digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist())
    table = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
    codes = np.asarray(coded.indices)
    return table[codes, 0], table[codes, 1]


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes; the order matters."""
    x = left * _A + (right ^ _B)
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on, by doubling. There are len(word) - n + 1; those that cross a
    text's end have to be left out by the caller."""
    if len(word) < n:
        return np.empty(0, dtype=np.uint64)
    width = 1
    while 2 * width <= n:
        word, width = mix(word[: len(word) - width], word[width:]), 2 * width
    return word if width == n else mix(word[: len(word) - (n - width)], word[n - width :])


def whole(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's whole word sequence. Rows of no words get 0."""
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    if len(word):
        place = np.arange(len(word), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
        each = mix(word, place * _A)
        some = np.diff(at) > 0
        out[some] = mix(np.add.reduceat(each, at[:-1][some]), np.diff(at)[some].astype(np.uint64))
    return out


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column text compressed, each text by itself, as squeezed: for rows that are about to be moved as a whole."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            packed = pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in part["text"].cast(pa.binary())], type=pa.binary())
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), packed], names=[*names, "squeezed"])


def unsqueezed(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts again; a null is an empty one."""
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x).decode() if x is not None else "" for x in column.to_pylist()], type=pa.string())
