"""Best-fit-decreasing packing of token sequences, certified by dual-feasible-function bounds.

Each partition packs its pieces by best fit decreasing and bounds the bins it needs from below. A partition that meets
its bound is certified optimal and done. Partitions with a gap keep their full bins and exchange the pieces of their
emptiest ones, in a number that follows from the gap; those are packed again, as long as that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.scratch import Scratch
from spanloom.llm.tokens import encoder

#: Pieces dealt to one partition: it bounds a task's memory, and is large enough that best fit meets its bound.
PARTITION_PIECES = 1 << 17
#: Bins that a partition gives up for each bin of its gap; never more than half of its bins or pieces, so that all
#: exchanges together move no more pieces than there are.
GIVEN = 4


def _pieces(tokenizer: str, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], dtype="<u4")
        for batch in batches:
            for part in W.slices(batch):
                owner, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(part["text"].fill_null("").to_pylist()):
                    ids = np.concatenate([encode(text), last]).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        owner.append(k)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].data))
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(owner, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()), pa.array(crc, type=pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[l] is the number of pieces of length l, from 0 to capacity."""
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    eps = np.arange(1, capacity // 2 + 1)[:, None]
    # pieces over capacity - eps fill a bin, those under eps count nothing
    clipped = np.where(size > capacity - eps, capacity, np.where(size >= eps, size, 0))
    best = max(best, int((-(-(clipped @ counts) // capacity)).max(initial=0)))
    # pieces over half a bin count what they leave to others, the rest 1 / floor(capacity / eps)
    fits = capacity // eps
    staged = np.where(2 * size > capacity, fits - (capacity - size) // eps, np.where(size >= eps, 1, 0))
    best = max(best, int((-(-(staged @ counts) // fits[:, 0])).max(initial=0)))
    # lengths rounded down to multiples of 1 / k, those on the grid of k + 1 as they are
    k = np.arange(1, 101)[:, None]
    even = (k + 1) * size % capacity == 0
    up = np.where(even, 0, (k + 1) * size // capacity) @ counts * capacity + np.where(even, size, 0) @ counts * k[:, 0]
    return max(best, int((-(-up // (k[:, 0] * capacity))).max(initial=0)))


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each piece's bin and its place there, and the number of bins. length must fall; every length is 1 to capacity."""
    bins, place = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for k, size in enumerate(length.tolist()):
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            one = left[room].pop()
            if not left[room]:
                mask &= ~(1 << room)
        else:
            room, one, used = capacity, used, used + 1
        bins[k], place[k] = one, capacity - room
        if room > size:
            left[room - size].append(one)
            mask |= 1 << (room - size)
    return bins, place, used


_PACKED = ("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "bins", "bound", "given", "rest_bins", "rest_bound")


def emptiest(fill: np.ndarray, pieces: np.ndarray, gap: int) -> np.ndarray:
    """Which bins to give up: the emptiest GIVEN for each bin of the gap, of at most half of all bins and pieces; one at
    least. None without a gap."""
    give = np.zeros(len(fill), dtype=bool)
    if gap:
        order = np.argsort(fill, kind="stable")[: max(1, min(GIVEN * gap, len(fill) // 2))]
        few = np.cumsum(pieces[order]) * 2 <= pieces.sum()
        few[0] = True
        give[order[few]] = True
    return give


def _pack(capacity: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        length = np.asarray(rows["length"])
        bins, place, used = best_fit(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        give = emptiest(np.bincount(bins, weights=length, minlength=used), np.bincount(bins, minlength=used), used - bound)
        given = give[bins]
        rest_bound = lower_bound(np.bincount(length[~given], minlength=capacity + 1), capacity)
        part = np.asarray(rows["part"]).astype(np.int64)
        of_part = {"bins": used, "bound": bound, "rest_bins": used - int(give.sum()), "rest_bound": rest_bound}
        new = {
            "sequence_id": pa.array((turn << 56) + (part << 32) + bins),
            "offset": pa.array(place),
            "given": pa.array(given),
            **{c: pa.array(np.full(len(length), n, dtype=np.int64)) for c, n in of_part.items()},
        }
        return pa.table({c: new[c] if c in new else rows[c] for c in _PACKED})

    return run


def _packed(rows: DataFrame, capacity: int, turn: int, parts: int) -> DataFrame:
    dealt = rows.select("id", "piece", "start", "length", "ids_crc32").withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
    schema = (
        "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
        "part int, bins long, bound long, given boolean, rest_bins long, rest_bound long"
    )
    return dealt.groupBy("part").applyInArrow(_pack(capacity, turn), schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end: int = 2,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    partition_pieces: int = PARTITION_PIECES,
    rounds: int | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound) for each piece of each row.

    A text is its ids by the tokenizer and then the id `end`; a longer one than capacity is cut into pieces of
    capacity, of which the first may be shorter. Pieces of a sequence follow each other without gaps from 0.
    The tokens are made once and written; packing moves only lengths. part_bins and part_bound are the certificate of
    the group of sequences that a piece was packed in: the bins it takes, and the number no packing of it can go below.
    rounds: exchanges at most; None goes on until all is certified or an exchange saves nothing.

    Nulls: a null text is an empty one, just `end`; null ids and repeated rows are packed like others. A hot text or
    source makes no difference, pieces are dealt by hash. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = scratch.put(texts.mapInArrow(_pieces(tokenizer, capacity, end), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    packed = pack_pieces(rows, capacity, scratch, partition_pieces, rounds)
    scratch.drop("pieces")
    return packed.withColumnRenamed("id", id_column)


def pack_pieces(rows: DataFrame, capacity: int, scratch: Scratch, partition_pieces: int = PARTITION_PIECES, rounds: int | None = None) -> DataFrame:
    """rows: id, piece, start, length (1 to capacity), ids_crc32; for each its sequence_id, offset, part_bins, part_bound.

    An exchange takes only the given bins of partitions with a gap, and deals their pieces to fewer partitions than they
    come from; where it saves nothing, the bins stay as they were.
    """
    columns = ("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    done, turn = [], 0
    last = scratch.put(_packed(rows, capacity, turn, max(1, -(-rows.count() // partition_pieces))), "round-0")
    while rounds is None or turn < rounds:
        given, open_parts, pieces = _given(last)
        if open_parts < 2:
            break
        turn += 1
        parts = max(1, min(open_parts - 1, -(-pieces // partition_pieces)))
        again = scratch.put(_packed(last.where("given"), capacity, turn, parts), f"round-{turn}")
        if _bins(again) >= given:
            scratch.drop(f"round-{turn}")
            break
        done.append(last.where("NOT given").select(*columns, F.col("rest_bins").alias("part_bins"), F.col("rest_bound").alias("part_bound")))
        last = again
    out = last.select(*columns, F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"))
    for more in done:
        out = out.unionByName(more)
    return out


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]


def _given(packed: DataFrame) -> tuple[int, int, int]:
    """Of the partitions with a gap: bins given up, number of partitions, pieces in those bins."""
    of = packed.where("given").groupBy("part").agg((F.first("bins") - F.first("rest_bins")).alias("bins"), F.count("*").alias("n"))
    return tuple(of.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())
