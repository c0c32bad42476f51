"""Near-duplicate vectors by lattice hashing.

Each table projects the unit vectors at random to a few blocks of eight dimensions and decodes each block to its
nearest point of the E8 lattice; the points together are the vector's home cell. Vectors of one home cell meet, and
each vector also probes the cells that differ in the one block that it lies closest to leaving. Every pair that meets
is verified by its cosine in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.components import connected_components
from spanloom.llm.scratch import Scratch


@dataclass(frozen=True)
class LatticeConfig:
    """A pair of cosine 0.9 that is otherwise random meets with probability over 0.99; nearer pairs more surely.

    blocks: E8 points of a cell; scale: size of a lattice cell on the unit sphere for vectors of 64 or more components,
    larger for shorter ones, of which a projection keeps more; block: vectors of one task's part of a hot cell."""

    cosine: float = 0.9
    tables: int = 10
    blocks: int = 3
    scale: float = 0.4
    probes: int = 8
    block: int = 1024
    seed: int = 5


def e8(points: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row (eight dimensions): the nearer of the best integer point with an even
    sum and the best such point shifted by one half."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        left = y[odd] - near[odd]
        worst = np.abs(left).argmax(axis=1)
        near[odd, worst] += np.where(left[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return near

    whole, half = even(points), even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of one half with an even number of minuses."""
    pairs = [[(s if k == i else t if k == j else 0) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(pairs + halves, dtype=float)


def _cell(points: np.ndarray) -> np.ndarray:
    """A hash of the lattice points of one block."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    out = np.full(len(points), 17, dtype=np.uint64)
    for k in range(8):
        out = W.mix(out, doubled[:, k])
    return out


def _scale(n: int, config: LatticeConfig) -> float:
    """Size of a lattice cell for n components: in cells, a pair's projections lie as far apart as at 64."""
    return config.scale * float(np.sqrt(64 / min(max(n, 8 * config.blocks), 64)))


def cells(unit: np.ndarray, config: LatticeConfig) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (vectors x tables) and probed cells (vectors x tables x probes) as hashes that differ by table."""
    draw, short = np.random.default_rng([config.seed, unit.shape[1]]), roots()
    home = np.empty((len(unit), config.tables), dtype=np.uint64)
    probed = np.empty((len(unit), config.tables, config.probes), dtype=np.uint64)
    per = -(-config.probes // config.blocks) + 1
    for t in range(config.tables):
        plane, _ = np.linalg.qr(draw.normal(size=(max(unit.shape[1], 8 * config.blocks), 8 * config.blocks)))
        plane = plane[: unit.shape[1]]
        shift = draw.random(8 * config.blocks) * 2
        y = unit @ plane / _scale(unit.shape[1], config) + shift
        codes, moved, gain = [], [], []
        for b in range(config.blocks):
            part = y[:, 8 * b : 8 * b + 8]
            point = e8(part)
            own = _cell(point)
            toward = (part - point) @ short.T
            best = np.argpartition(-toward, per, axis=1)[:, :per]
            codes.append(own)
            for k in range(per):
                moved.append((b, _cell(point + short[best[:, k]]) - own))
                gain.append(toward[np.arange(len(unit)), best[:, k]])
        # a cell is the sum of its blocks' codes, each turned by its block, so that a probe changes one term
        turn = np.array([2 * b + 1 for b in range(config.blocks)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total = sum(c * turn[b] for b, c in enumerate(codes))
        order = np.argsort(-np.stack(gain, axis=1), axis=1, kind="stable")[:, : config.probes]
        changed = np.stack([total + d * turn[b] for b, d in moved], axis=1)
        salt = np.uint64(t + 1)
        home[:, t] = W.mix(total, np.full(len(unit), salt))
        probed[:, t] = W.mix(np.take_along_axis(changed, order, axis=1), np.full((len(unit), config.probes), salt))
    return home, probed


def _placer(config: LatticeConfig, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells and a short form of each usable vector; the rest get nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                out = {c: [None] * part.num_rows for c in ("high", "low", "raw", "short", "home", "probed")}
                vectors = part["vector"]
                length = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0))
                for n in np.unique(length[length > 0]):
                    rows = np.flatnonzero(length == n)
                    values = vectors.take(pa.array(rows)).flatten()
                    raw = np.asarray(pa.compute.fill_null(values, float("nan")), dtype=kind).reshape(-1, n)
                    with np.errstate(all="ignore"):
                        exact = raw.astype(np.float64)
                        exact /= np.abs(exact).max(axis=1)[:, None]  # so that no square runs over or under
                        exact /= np.sqrt((exact**2).sum(axis=1))[:, None]
                    fine = np.isfinite(exact).all(axis=1) & np.isfinite(raw).all(axis=1)
                    rows, raw, exact = rows[fine], raw[fine] + 0.0, exact[fine]
                    if not len(rows):
                        continue
                    home, probed = cells(exact, config)
                    short = np.rint(exact / np.abs(exact).max(axis=1)[:, None] * 32767).astype("<i2")
                    for k, row in enumerate(rows):
                        data = raw[k].astype(kind).tobytes()
                        digest = np.frombuffer(W.xxhash.xxh3_128_digest(data), dtype=np.int64)
                        out["high"][row], out["low"][row] = int(digest[0]), int(digest[1])
                        out["raw"][row], out["short"][row] = data, short[k].tobytes()
                        out["home"][row], out["probed"][row] = home[k].view(np.int64), probed[k].ravel().view(np.int64)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(out["high"], pa.int64()), pa.array(out["low"], pa.int64()), pa.array(out["raw"], pa.binary()), pa.array(out["short"], pa.binary()), pa.array(out["home"], longs), pa.array(out["probed"], longs)],
                    names=["id", "high", "low", "raw", "short", "home", "probed"],
                )

    return run


def _unit(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _homes(column: pa.ChunkedArray, tables: int) -> np.ndarray:
    return np.asarray(pa.compute.list_flatten(column)).reshape(-1, tables)


def _dense(config: LatticeConfig, kind: str) -> Callable[[pa.Table], pa.Table]:
    """One block of a home cell: how many links each vector has in it that no earlier table shows, counted with copies,
    and the links that join the block's components."""

    def run(rows: pa.Table) -> pa.Table:
        node, side, copies = (np.asarray(rows[c]) for c in ("node", "side", "copies"))
        table, i, j = rows["table"][0].as_py(), rows["i"][0].as_py(), rows["j"][0].as_py()
        unit, home = _unit(rows["raw"], kind), _homes(rows["home"], config.tables)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found, parent = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        a, b = [], []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in left:
            others = right[right > x] if i == j else right
            near = others[unit[others] @ unit[x] >= config.cosine] if len(others) else others
            near = near[(home[near] == home[x]).argmax(axis=1) == table] if len(near) else near
            if not len(near):
                continue
            found[x] += copies[near].sum()
            found[near] += copies[x]
            for y in near:
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(node[x])
                    b.append(node[y])
        some = np.flatnonzero(found)
        return pa.table({"a": pa.array([*a, *node[some]], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()), "n": pa.array([*[0] * len(a), *found[some]], pa.int64())})

    return run


def _sparse(config: LatticeConfig) -> Callable[[pa.Table], pa.Table]:
    """One block of a cell and of those that probe it: pairs near enough by their short forms that share no home."""

    def run(rows: pa.Table) -> pa.Table:
        node, probing = np.asarray(rows["node"]), np.asarray(rows["probing"])
        x = np.frombuffer(b"".join(rows["short"].to_pylist()), dtype="<i2").reshape(len(node), -1).astype(np.float64)
        x /= np.sqrt((x**2).sum(axis=1))[:, None]
        home = _homes(rows["home"], config.tables)
        at, least = np.flatnonzero(~probing), config.cosine - 2 * np.sqrt(x.shape[1]) / 32767
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for q in np.flatnonzero(probing):
            near = at[(x[at] @ x[q] >= least) & (node[at] != node[q])] if len(at) else at
            near = near[~(home[near] == home[q]).any(axis=1)] if len(near) else near
            a.append(np.minimum(node[near], node[q]))
            b.append(np.maximum(node[near], node[q]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _verified(config: LatticeConfig, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_unit(batch["raw_a"], kind) * _unit(batch["raw_b"], kind)).sum(axis=1) >= config.cosine
                yield batch.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(near))

    return run


def linked_vectors(vectors: DataFrame, config: LatticeConfig | None = None, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Two rows are linked when their cosine is at least config.cosine; every link found is verified in double precision.
    n_links counts the other rows linked directly, component_id is the least id reachable, kept is whether that is the
    row's own. Equal vectors are one class throughout, so copies cost nothing and lose no link.

    Nulls: a vector that is null, empty, zero or holds a null or non-finite component is linked with nothing, and so is
    a row with a null id, which has a null component_id and is kept. Vectors of different lengths are never linked.
    Repeated rows count as other rows. Other columns are ignored; an empty table gives an empty one.
    """
    config = config or LatticeConfig()
    scratch = Scratch(vectors.sparkSession, "lattice")
    kind = "<f4" if vectors.schema[vector_column].dataType.elementType.typeName() == "float" else "<f8"
    cast = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(cast).alias("vector"))
    placed = scratch.put(rows.mapInArrow(_placer(config, kind), "id long, high long, low long, raw binary, short binary, home array<long>, probed array<long>"), "placed")
    classes = scratch.put(placed.where("raw IS NOT NULL AND id IS NOT NULL").groupBy("high", "low").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "classes")
    one = placed.where("raw IS NOT NULL").withColumnsRenamed({"high": "p", "low": "q"}).dropDuplicates(["id", "p", "q"])
    one = scratch.put(one.join(classes, (F.col("p") == F.col("high")) & (F.col("q") == F.col("low")) & (F.col("id") == F.col("node"))).select("node", "copies", F.octet_length("raw").alias("length"), "raw", "short", "home", "probed"), "one")

    # the length of the vector is part of a cell, so that only vectors of one length meet
    keyed = one.select("node", "length", F.posexplode("home").alias("table", "cell")).select("node", "table", F.xxhash64("cell", "length").alias("cell"))
    busy = keyed.groupBy("table", "cell").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    at_home = keyed.join(busy.where("n > 1"), ["table", "cell"]).withColumn("blocks", F.ceil(F.col("n") / config.block).cast("int"))
    spread = (
        at_home.withColumn("side", F.pmod(F.xxhash64("node", F.lit(config.seed)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("table", "cell", "node", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    )
    dense = scratch.put(spread.join(one.select("node", "copies", "raw", "home"), "node").groupBy("table", "cell", "i", "j").applyInArrow(_dense(config, kind), "a long, b long, n long"), "dense")

    probing = one.select("node", "length", F.posexplode("probed").alias("k", "cell")).select("node", F.floor(F.col("k") / config.probes).cast("int").alias("table"), F.xxhash64("cell", "length").alias("cell"))
    visits = probing.join(busy, ["table", "cell"]).select("table", "cell", "node", "n")
    visits = scratch.put(visits, "visits")
    visited = visits.groupBy("table", "cell").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    blocks = lambda c: F.ceil(F.col(c) / config.block).cast("int")
    part = lambda c: F.pmod(F.xxhash64("node", F.lit(config.seed + 1)), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    hosts = keyed.join(visited, ["table", "cell"]).withColumn("i", part("n")).withColumn("j", every("m")).select("table", "cell", "node", "i", "j", F.lit(False).alias("probing"))
    guests = visits.drop("n").join(visited, ["table", "cell"]).withColumn("j", part("m")).withColumn("i", every("n")).select("table", "cell", "node", "i", "j", F.lit(True).alias("probing"))
    meeting = hosts.unionByName(guests).join(one.select("node", "short", "home"), "node")
    pairs = meeting.groupBy("table", "cell", "i", "j").applyInArrow(_sparse(config), "a long, b long").distinct()
    side = lambda s: one.select(F.col("node").alias(s), F.col("raw").alias(f"raw_{s}"), F.col("copies").alias(f"copies_{s}"))
    links = scratch.put(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b", "copies_a", "copies_b").mapInArrow(_verified(config, kind), "a long, b long, copies_a long, copies_b long"), "links")

    counts = dense.where("b IS NULL").select(F.col("a").alias("node"), "n")
    counts = counts.unionByName(links.select(F.col("a").alias("node"), F.col("copies_b").alias("n"))).unionByName(links.select(F.col("b").alias("node"), F.col("copies_a").alias("n")))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    reached = connected_components(dense.where("b IS NOT NULL").select("a", "b").unionByName(links.select("a", "b")), scratch)
    of = classes.join(counts, "node", "left").join(reached, "node", "left").select("high", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    scratch.drop("one", "visits")
    out = placed.select("id", "high", "low").join(of, ["high", "low"], "left")
    none = F.col("id").isNull()
    component = F.when(none, F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    links_of = F.when(none, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return out.select(F.col("id").alias(id_column), links_of.alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
