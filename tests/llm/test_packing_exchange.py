from collections import Counter

import numpy as np
from data import frame

from spanloom.llm import packing, tokens
from spanloom.llm.scratch import Scratch


def packed(spark, lengths, capacity, size, rounds=None):
    rows = spark.createDataFrame([(k, 0, 0, int(n), k) for k, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    return packing.pack_pieces(rows, capacity, Scratch(spark, "test"), size, rounds).collect()


def check(rows, lengths, capacity):
    """Every piece once and gapless; and each certificate true. The number of sequences."""
    assert Counter((r["id"], r["length"]) for r in rows) == Counter((k, int(n)) for k, n in enumerate(lengths))
    ends, parts = {}, {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        parts.setdefault((r["sequence_id"] >> 32, r["part_bins"], r["part_bound"]), []).append(r)
    assert max(ends.values(), default=0) <= capacity
    for (_, bins, bound), own in parts.items():
        assert len({r["sequence_id"] for r in own}) == bins >= bound
        assert bound == packing.lower_bound(np.bincount([r["length"] for r in own], minlength=capacity + 1), capacity)
    return len(ends)


def test_an_exchange_saves_bins(spark):
    draw = np.random.default_rng(6)
    lengths = draw.integers(18, 52, 600)
    alone = check(packed(spark, lengths, 100, 20, rounds=0), lengths, 100)
    every = check(packed(spark, lengths, 100, 20), lengths, 100)
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= every < alone


def test_certified_partitions_exchange_nothing(spark):
    lengths = [6] * 40 + [4] * 3
    rows = packed(spark, lengths, 10, 8)
    assert check(rows, lengths, 10) == 40 and all(r["part_bins"] == r["part_bound"] and r["sequence_id"] >> 56 == 0 for r in rows)
    assert packed(spark, [], 10, 8) == []


def test_given_bins_are_the_emptiest_and_at_most_half():
    fill, pieces = np.array([9, 3, 10, 1, 8, 10]), np.array([3, 1, 2, 1, 2, 2])
    assert not packing.emptiest(fill, pieces, 0).any()
    assert np.flatnonzero(packing.emptiest(fill, pieces, 1)).tolist() == [1, 3, 4]
    assert np.flatnonzero(packing.emptiest(np.array([2, 5]), np.array([9, 1]), 3)).tolist() == [0]


def test_optimum_on_small_sets(spark):
    """Against an exhaustive search of the least number of bins, and never under the bound."""

    def least(lengths, capacity):
        best = len(lengths)

        def place(k, room):
            nonlocal best
            if len(room) >= best:
                return
            if k == len(lengths):
                best = len(room)
                return
            for one in {r for r in room if r >= lengths[k]}:
                place(k + 1, [*(room[: room.index(one)]), one - lengths[k], *room[room.index(one) + 1 :]])
            place(k + 1, [*room, capacity - lengths[k]])

        place(0, [])
        return best

    draw = np.random.default_rng(8)
    for _ in range(30):
        lengths = sorted(draw.integers(2, 13, 8).tolist(), reverse=True)
        used, bound = packing.best_fit(np.array(lengths), 13)[2], packing.lower_bound(np.bincount(lengths, minlength=14), 13)
        assert bound <= least(lengths, 13) <= used <= least(lengths, 13) + 1


def test_encoder_takes_endless_runs():
    encode, library = tokens.encoder("byte_bpe_50k.json"), tokens.library("byte_bpe_50k.json")
    for text in ("y" * 50_000, "ab1!" * 9000, " " * 1_500_000 + "x", "\n" * 30_000):
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_packing_of_long_texts_and_columns_that_clash(spark):
    rows = [(1, "word " * 9000), (2, "word " * 9000), (None, "a"), (2, None)]
    found = packing.pack(frame(spark, rows).withColumnRenamed("tag", "part").withColumnRenamed("kept", "given"), "byte_bpe_50k.json").collect()
    assert sum(r["length"] for r in found) == sum(len(tokens.library("byte_bpe_50k.json").encode(t or "").ids) + 1 for _, t in rows)
