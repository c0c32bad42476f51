"""MinHash near-duplicate groups: universal hash minima, bands, signature check, exact check, components.

1. One pass sketches every text: the set of distinct word shingles gives a key (equal sets, equal key), K minima and
   the band hashes. Texts of equal sets are one class from here on, so thousands of copies cost one row.
2. Classes that share a band with others are compared with the least class of that band; the pair of a class with
   the best signature agreement is confirmed on full sets. That joins nearly everything.
3. Bands that still hold several components are searched in full: members meet in blocks of bounded size, and pairs of
   different components that pass the signature check are compared exactly, by their differences from one common set.
   A block gives only the links that join its components. So no link that shares a band is lost, and a band whose
   members are already one component costs nothing.
4. Components by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.components import connected_components
from spanloom.llm.scratch import Scratch, unused


@dataclass(frozen=True)
class MinHashConfig:
    """shingle: words in a shingle. percent: least similarity of a link in hundredths. bands x rows minima.

    With 25 bands of 5 rows a pair of similarity 0.85 shares no band once in two million times, one of 0.8 once in
    24,000; slack is five standard deviations of the agreement of 125 minima. block, block_bytes: members of a band that
    meet others in one task, and bytes of what tells them from their hub.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 5
    slack: float = 0.17
    block: int = 4096
    block_bytes: int = 32 << 20
    seed: int = 7


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, where each row's begin, and the second half of each set's key."""
    flat, at = W.split(text, lower=True)
    first, second = W.hashes(flat)
    gram, wholes, second_whole = W.grams(first, n), W.whole(first, at), W.whole(second, at)
    sets, check = [], np.zeros(len(at) - 1, dtype=np.uint64)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        sets.append(np.unique(gram[a : b - n + 1]) if b - a >= n else wholes[k : k + 1] if b > a else gram[:0])
        if 0 < b - a < n:
            check[k] = second_whole[k]
    return np.concatenate(sets or [gram[:0]]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), check


def _keys(members: np.ndarray, at: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set; 0 and 0 for an empty one."""
    high, low = np.zeros(len(at) - 1, dtype=np.uint64), np.zeros(len(at) - 1, dtype=np.uint64)
    some = np.diff(at) > 0
    if some.any():
        size = np.diff(at)[some].astype(np.uint64)
        high[some] = W.mix(np.add.reduceat(W.mix(members, members ^ np.uint64(11)), at[:-1][some]), size)
        low[some] = W.mix(np.add.reduceat(W.mix(members ^ np.uint64(29), members), at[:-1][some]), size ^ check[some])
    return high, low


def _sketcher(config: MinHashConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(config.seed)
        k = config.bands * config.rows
        by = draw.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = draw.integers(0, 1 << 63, k, dtype=np.uint64)
        for batch in batches:
            for part in W.slices(batch):
                members, at, check = shingle_sets(part["text"], config.shingle)
                high, low = _keys(members, at, check)
                some = np.diff(at) > 0
                minima = np.zeros((int(some.sum()), k), dtype=np.uint64)
                starts = at[:-1][some]
                for j in range(k if len(starts) else 0):
                    minima[:, j] = np.minimum.reduceat((members * by[j] + plus[j]) >> np.uint64(32), starts)
                banded = minima.reshape(-1, config.bands, config.rows)
                band = np.repeat(np.arange(config.bands, dtype=np.uint64)[None], len(banded), 0)
                for r in range(config.rows):
                    band = W.mix(band, banded[:, :, r])
                out_bands, out_sig = np.zeros((len(some), config.bands), dtype=np.uint64), np.zeros((len(some), k), dtype=np.uint16)
                out_bands[some], out_sig[some] = band, minima.astype(np.uint16)
                flat_sig = out_sig.view(np.uint8).reshape(len(some), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array(np.diff(at)),
                        W.signed(high),
                        W.signed(low),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * config.bands), W.signed(out_bands.ravel())),
                        pa.array([x.tobytes() for x in flat_sig], type=pa.binary()),
                    ],
                    names=["id", "n_shingles", "high", "low", "bands", "sig"],
                )

    return run


def _sets(config: MinHashConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "squeezed", W.SLICE_BYTES // 2):
                members, at, check = shingle_sets(W.unsqueezed(part["squeezed"]), config.shingle)
                high, low = _keys(members, at, check)
                same = (high.view(np.int64) == np.asarray(part["high"])) & (low.view(np.int64) == np.asarray(part["low"]))
                for k in np.flatnonzero(same):
                    yield pa.RecordBatch.from_arrays([part["id"].slice(k, 1), pa.array([members[at[k] : at[k + 1]].tobytes()], type=pa.binary())], names=["id", "members"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in run(batches):
            held.append(one)
            size += len(one["members"][0].as_buffer())
            if size > W.SLICE_BYTES or len(held) >= 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return merged


def _agreement(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the share of equal minima of sig_a and sig_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint16).reshape(-1, k) for c in ("sig_a", "sig_b"))
            share = (a == b).mean(axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(share, type=pa.float64())], names=["a", "b", "share"])

    return run


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["members_a"], batch["members_b"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a member's set lacks of its hub's and has besides: all that is needed to compare two members exactly."""
    for batch in batches:
        minus, plus, size = [], [], []
        for x, y in zip(batch["members_a"], batch["members_b"], strict=True):
            own, hub = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            minus.append(np.setdiff1d(hub, own, assume_unique=True).tobytes())
            plus.append(np.setdiff1d(own, hub, assume_unique=True).tobytes())
            size.append(len(hub))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(size, type=pa.int64()), pa.array(minus, type=pa.binary()), pa.array(plus, type=pa.binary())], names=["a", "b", "hub_size", "minus", "plus"])


class _Ragged:
    """Sets of numbers of many rows, for counting what each has in common with one of them."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        each = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]
        self.size = np.array([len(x) for x in each])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        values, self.code = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *each]), return_inverse=True)
        self.flag = np.zeros(len(values), dtype=bool)

    def common(self, y: int, rows: np.ndarray) -> np.ndarray:
        """How many numbers each of the rows shares with row y."""
        own, size = self.code[self.at[y] : self.at[y + 1]], self.size[rows]
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(self.at[rows] - ends + size, size)
        self.flag[own] = True
        hits = np.concatenate([[0], np.cumsum(self.flag[self.code[places]])])
        self.flag[own] = False
        return hits[ends] - hits[ends - size]


def _link(k: int, bands: int, percent: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """Links between components in one block of a band, no more than join the components there.

    Pairs of different components that agree enough and share no earlier band are compared exactly, by what each of
    them lacks of the hub and has besides."""

    def run(rows: pa.Table) -> pa.Table:
        node, side, size = (np.asarray(rows[c]) for c in ("node", "side", "n_shingles"))
        _, part = np.unique(np.asarray(rows["component"]), return_inverse=True)
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), dtype=np.uint16).reshape(-1, k)
        band = np.asarray(pa.compute.list_flatten(rows["bands"])).reshape(-1, bands)
        number, hub = rows["band"][0].as_py(), rows["hub_size"][0].as_py()
        diagonal = rows["i"][0].as_py() == rows["j"][0].as_py()
        minus, plus = _Ragged(rows["minus"]), _Ragged(rows["plus"])
        count = np.bincount(part)
        left, right = [], []
        for y in np.lexsort((node, part, count[part]))[: len(node) - count.max()]:  # members of the largest are met by all others
            near = np.flatnonzero((part != part[y]) & (diagonal | (side != side[y])))
            near = near[(sig[near] == sig[y]).mean(axis=1) >= least]
            near = near[(band[near] == band[y]).argmax(axis=1) == number] if len(near) else near
            if not len(near):
                continue
            both = hub - (minus.size[near] + minus.size[y] - minus.common(y, near)) + plus.common(y, near)
            linked = near[100 * both >= percent * (size[near] + size[y] - both)]
            for x in linked:
                if part[x] != part[y]:
                    left.append(node[y])
                    right.append(node[x])
                    old, new = part[y], part[x]
                    part[part == old] = new
        return pa.table({"a": pa.array(left, type=pa.int64()), "b": pa.array(right, type=pa.int64())})

    return run


def near_duplicates(docs: DataFrame, config: MinHashConfig | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs: its group of near duplicates.

    Two rows are linked when the sets of their distinct shingles (lower-cased A-Z, words between ASCII white space; the
    whole sequence where there are fewer words) have at least `percent` hundredths of their union in common. A link is
    found if the two share a band, and is always confirmed on the full sets. component_id is the least id reachable,
    kept tells whether that is the row's own.

    Nulls: a null text or one without words has an empty set and is linked with nothing; a row with a null id is linked
    with nothing, has a null component_id and is kept. Repeated rows each appear, with the same result. Other columns
    of docs are ignored, whatever their names; an empty table gives an empty one.
    """
    config = config or MinHashConfig()
    spark, k = docs.sparkSession, config.bands * config.rows
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sketch = scratch.put(texts.mapInArrow(_sketcher(config), "id long, n_shingles long, high long, low long, bands array<long>, sig binary"), "sketch")

    # a class has a number of its own, as one id with several texts can be the least of several classes
    classes = sketch.where("n_shingles > 0 AND id IS NOT NULL").groupBy("high", "low").agg(F.min("id").alias("least"))
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = sketch.join(classes.withColumnRenamed("least", "id"), ["id", "high", "low"])
    banded = member.select("node", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub <> far").select("h", "hub")
    bucket = scratch.put(banded.join(shared, "h").select("h", "band", "node", "hub"), "buckets")

    met = bucket.select("node").distinct()
    sigs = scratch.put(member.select("node", "n_shingles", "sig", "bands").join(met, "node", "left_semi").dropDuplicates(["node"]), "sigs")
    needed = scratch.put(classes.join(met, "node", "left_semi"), "needed")
    sets = scratch.put(texts.mapInArrow(W.squeeze, "id long, squeezed binary").join(needed.hint("merge"), F.col("id") == F.col("least")).select(F.col("node").alias("id"), "squeezed", "high", "low").mapInArrow(_sets(config), "id long, members binary").dropDuplicates(["id"]), "sets")

    def with_sets(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("id").alias("a"), F.col("members").alias("members_a")), sets.select(F.col("id").alias("b"), F.col("members").alias("members_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "members_a", "members_b")

    a, b = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    stars = bucket.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    least = config.percent / 100 - config.slack
    agreed = stars.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agreement(k), "a long, b long, share double").where(F.col("share") >= least)
    best = agreed.groupBy("a").agg(F.max_by("b", F.struct("share", -F.col("b"))).alias("b"))
    links = scratch.put(with_sets(best).mapInArrow(_confirm(config.percent), "a long, b long"), "links-1")
    reached = connected_components(links, scratch, "first")

    placed = scratch.put(bucket.join(reached, "node", "left").select("h", "band", "node", F.coalesce("component", "node").alias("component")).distinct(), "placed")
    mixed = placed.groupBy("h").agg(F.min("component").alias("hub"), F.max("component").alias("far")).where("hub <> far")
    open_ = scratch.put(placed.join(mixed, "h").select("h", "band", "node", "component", "hub"), "open")
    differ = with_sets(open_.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()).mapInArrow(_differences, "a long, b long, hub_size long, minus binary, plus binary")
    differ = scratch.put(differ.withColumnsRenamed({"a": "node", "b": "hub"}).join(sigs, "node"), "differ")
    weighed = open_.join(differ.select("node", "hub", (F.octet_length("minus") + F.octet_length("plus") + F.octet_length("sig")).cast("long").alias("bytes")), ["node", "hub"])
    sizes = weighed.groupBy("h").agg(F.ceil(F.greatest(F.count("*") / config.block, F.sum("bytes") / config.block_bytes)).cast("int").alias("blocks"))
    blocked = (
        open_.join(sizes, "h")
        .withColumn("side", F.pmod(F.xxhash64("node", F.lit(config.seed)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h", "band", "node", "component", "hub", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
        .join(differ, ["node", "hub"])
    )
    more = scratch.put(blocked.groupBy("h", "i", "j").applyInArrow(_link(k, config.bands, config.percent, least), "a long, b long"), "links-2")
    both = connected_components(links.unionByName(more), scratch, "last")

    first = both.join(classes, "node").groupBy("component").agg(F.min("least").alias("first"))
    grouped = classes.join(both.join(first, "component").select("node", "first"), "node", "left").select("high", "low", F.coalesce("first", "least").alias("component"))
    rows = sketch.select("id", "n_shingles", "high", "low").join(grouped, ["high", "low"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    scratch.drop("buckets", "sigs", "needed", "sets", "placed", "open", "differ")
    return rows.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, config: MinHashConfig | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without all but one row of each group. Of rows with one id the first by a hash of the text, then the text,
    stays; null ids, null texts and texts without words are linked with nothing and stay (but for repeated ids). Columns
    stay as they are, whatever their names; an empty table stays empty.

    Rows without an id take no part in the join, and only rows of repeated ids are gathered by id, combined before the
    shuffle; so neither null ids nor one id of many rows make a large task."""
    groups = near_duplicates(docs, config, id_column=id_column, text_column=text_column).where(F.col(id_column).isNotNull())
    own, times, row = (unused(docs.columns, c) for c in ("_stays", "_times", "_row"))
    stays = groups.groupBy(F.col(id_column).alias(own)).agg(F.count("*").alias(times), F.max("kept").alias("kept")).where("kept").select(own, times)
    kept = docs.where(F.col(id_column).isNotNull()).join(stays, F.col(id_column).cast("long") == F.col(own))
    text = F.col(text_column).cast("string")
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.xxhash64(text), text)).alias(row)
    again = kept.where(F.col(times) > 1).groupBy(own).agg(least).select(*(F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
    alone = kept.where(F.col(times) == 1).drop(own, times)
    return alone.unionByName(again).unionByName(docs.where(F.col(id_column).isNull()))
