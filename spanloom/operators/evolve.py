"""From uncovered text to schema changes: signals, embeddings, nearest neighbours, rank fusion, buckets, routing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from spanloom.functions import text as T

#: Conclusions that lead to proposals. Fixed values.
PROPOSING = ("new_schema", "new_attr")
EMBED_TOKENS = r"[A-Za-z0-9_./:-]+"


@dataclass(frozen=True)
class RouteConfig:
    """top_k hits of each index, fused with 1 / (fuse + rank); the best bucket of at least `threshold` is reused.

    similarity: "fused" ranks buckets by the fused scores, as given; those never pass tau_low, so no bucket is ever
    reused. "cosine" ranks by the better cosine of the two indexes."""

    top_k: int = 20
    fuse: int = 60
    threshold: float = 0.6
    tau_high: float = 0.75
    tau_low: float = 0.45
    alpha: float = 0.3
    epsilon: float = 1e-9
    similarity: str = "fused"


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, slot, value): the non-zero entries of each text's unit vector; a text without tokens has none.

    A token's slot is the first four bytes of its SHA-256, its sign the parity of the fifth."""
    words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(EMBED_TOKENS), 0)).alias("_t"))
    counted = words.groupBy(key, "_t").agg(F.count("*").alias("_n")).withColumn("_h", F.sha2("_t", 256))
    slot = (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("_h", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    entries = counted.groupBy(key, slot.alias("slot")).agg(F.sum(F.col("_n") * sign).cast("double").alias("_v")).where("_v <> 0")
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(key)))
    return entries.select(key, "slot", (F.col("_v") / norm).alias("value"))


def dense(entries: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """(key, vector array<double>) of sparse entries."""
    pairs = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_m"))
    return pairs.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


#: Most entries of the index and most queries that one task holds at a time.
INDEX_PART, QUERY_PART = 32_768, 8_192


def nearest(queries: DataFrame, index: DataFrame, k: int = 20, index_name: str = "index", query_block: int = QUERY_PART, index_block: int = INDEX_PART) -> DataFrame:
    """(query_id, signal_id, bucket_id, similarity, rank, index_name): the k most alike entries of each query.

    queries: query_id, vector, a stated set against the whole index (signal_id, bucket_id, vector). Both are counted and
    dealt to a grid of parts of about `query_block` by `index_block` rows; each pair of parts is one group, whose products
    are made in blocks by matrices of single precision. What they can't rule out is computed again by the fold of
    `cosine`. Ties go to the lesser signal_id. Each group keeps its own best k of each query for the last ranking."""
    rows, columns = (max(1, -(-x.count() // most)) for x, most in ((queries, query_block), (index, index_block)))
    dealt = lambda x, key, own, n, other, m: x.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = dealt(queries.select("query_id", "vector"), "query_id", "_h", rows, "_g", columns).groupBy("_g", "_h")
    e = dealt(index.select("signal_id", "bucket_id", "vector"), "signal_id", "_g", columns, "_h", rows).groupBy("_g", "_h")
    schema = StructType([queries.schema["query_id"], index.schema["signal_id"], index.schema["bucket_id"]]).add("similarity", DoubleType())

    def run(asked: pa.Table, entries: pa.Table) -> pa.Table:
        a, b, similarity = _best(_vectors(asked["vector"]), _vectors(entries["vector"]), _places(entries), k)
        out = [asked["query_id"].take(pa.array(a)), entries["signal_id"].take(pa.array(b)), entries["bucket_id"].take(pa.array(b)), pa.array(similarity)]
        return pa.table(out, names=schema.names)

    best = q.cogroup(e).applyInArrow(run, schema)
    return _top(best, ["query_id"], k).select("query_id", "signal_id", "bucket_id", "similarity", F.col("_rank").alias("rank"), F.lit(index_name).alias("index_name"))


def _places(entries: pa.Table) -> np.ndarray:
    """The place of each entry in the order of signals and buckets, nulls first."""
    order = np.asarray(pc.sort_indices(entries, sort_keys=[("signal_id", "ascending"), ("bucket_id", "ascending")], null_placement="at_start"))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of doubles filled up with zeros, and the vectors' lengths; -1 for those that are null or hold a null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), size)
    null = np.asarray(flat.is_null())
    out = np.zeros((len(lists), int(size.max()) if len(size) else 0))
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0))
    size[np.asarray(lists.is_null())] = -1
    size[of[null]] = -1
    return out, size


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first component on as `dot` does."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _best(asked: tuple, entries: tuple, place: np.ndarray, k: int, step: int = 256, width: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of entries, similarity) of each asked vector's k best, ties by place. NaN is the greatest, as in
    Spark's order. Vectors of unlike lengths, and those that hold nulls, are 0 to each other."""
    (q, nq), (e, ne) = asked, entries
    dim = max(q.shape[1], e.shape[1])
    q, e = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, e))
    with np.errstate(all="ignore"):
        sq, se = _dots(q, q), _dots(e, e)
        # what single precision can't hold is never ruled out
        odd_q, odd_e = (~((s == 0) & (np.abs(x).max(axis=1, initial=0) == 0) | (s > 1e-60) & (s < 1e60)) for s, x in ((sq, q), (se, e)))
        unit = lambda x, s, odd: np.where((odd | (s == 0))[:, None], 0.0, x / np.sqrt(s)[:, None]).astype(np.float32)
        uq, ue = unit(q, sq, odd_q), unit(e, se, odd_e)
    margin, out = np.float32(4e-7 * (dim + 8)), []
    for a in range(0, len(q), step):
        some = slice(a, min(a + step, len(q)))
        least = np.full(some.stop - a, -np.inf, dtype=np.float32)
        kept = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        for b in range(0, len(e), width):
            to = min(b + width, len(e))
            near = uq[some] @ ue[b:to].T
            near[(nq[some, None] != ne[None, b:to]) | (nq[some, None] < 0)] = 0
            sure = np.where(odd_e[None, b:to] | odd_q[some, None], -np.inf, near)
            if to - b > k:
                least = np.maximum(least, np.partition(sure, to - b - k, axis=1)[:, to - b - k])
            x, y = np.nonzero((near >= (least - margin)[:, None]) | odd_e[None, b:to] | odd_q[some, None])
            for c in range(0, len(x), 1 << 18):  # bounded where very many are alike
                x_, y_ = x[c : c + (1 << 18)], y[c : c + (1 << 18)] + b
                with np.errstate(all="ignore"):
                    below = np.sqrt(sq[a + x_] * se[y_])
                    s = np.where(below == 0, 0.0, _dots(q[a + x_], e[y_]) / below)
                s[(nq[a + x_] != ne[y_]) | (nq[a + x_] < 0)] = 0
                kept = _first(*(np.concatenate(v) for v in zip(kept, (x_, y_, s), strict=True)), place, k)
        out.append((kept[0] + a, kept[1], kept[2]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.empty(0, dtype=(np.int64, np.int64, float)[j]) for j in range(3))


def _first(x: np.ndarray, y: np.ndarray, s: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((place[y], np.where(np.isnan(s), -np.inf, -s), ~np.isnan(s), x))
    x, y, s = x[order], y[order], s[order]
    begin = np.searchsorted(x, x, side="left")
    fit = np.arange(len(x)) - begin < k
    return x[fit], y[fit], s[fit]


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("similarity"), "signal_id", "bucket_id")
    return rows.drop("_rank").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def fused(hits: DataFrame, fuse: int = 60) -> DataFrame:
    """Hits of several indexes as one ranking by the sum of 1 / (fuse + rank), least rank kept as first."""
    both = hits.groupBy("query_id", "signal_id", "bucket_id").agg(F.sum(1.0 / (fuse + F.col("rank"))).alias("similarity"), F.min("rank").alias("best_rank"), F.max("similarity").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "best_rank", "signal_id", "bucket_id"))
    return both.withColumn("rank", place)


def hit_weight(s: Column, c: RouteConfig) -> Column:
    """Over tau_high up to 1, under tau_low down to -1, between them a little."""
    return F.when(s >= c.tau_high, (s - c.tau_high) / (1 - c.tau_high)).when(s <= c.tau_low, -((c.tau_low - s) / c.tau_low)).otherwise(c.alpha * ((s - c.tau_low) / (c.tau_high - c.tau_low)))


def bucket_scores(hits: DataFrame, config: RouteConfig | None = None, by: str = "query_id") -> DataFrame:
    """(by, bucket_id, score, support, high, low, members, rank): log1p of the effective number of good hits times the
    sum of all weights."""
    c = config or RouteConfig()
    s = F.col("similarity" if c.similarity == "fused" or "cosine" not in hits.columns else "cosine")
    good = F.when(F.col("_w") > 0, F.col("_w")).otherwise(0.0)
    summed = hits.withColumn("_s", s).withColumn("_w", hit_weight(F.col("_s"), c)).groupBy(by, "bucket_id").agg(
        F.sum(good).alias("_p"), F.sum(good * good).alias("_q"), F.sum("_w").alias("_t"), F.count("*").alias("support"), F.sum((F.col("_s") >= c.tau_high).cast("long")).alias("high"), F.sum((F.col("_s") <= c.tau_low).cast("long")).alias("low"), F.sort_array(F.collect_list("signal_id")).alias("members")
    )
    score = F.log1p(F.col("_p") * F.col("_p") / (F.col("_q") + c.epsilon)) * F.col("_t")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "bucket_id"))
    return summed.withColumn("score", score).select(by, "bucket_id", "score", "support", "high", "low", "members").withColumn("rank", place)


def routes(signals: DataFrame, scores: DataFrame, config: RouteConfig | None = None) -> DataFrame:
    """(query_id, bucket_id, created, score, route_reason) for each signal (query_id): its best bucket if that scores
    enough, else a new one named after the signal."""
    c = config or RouteConfig()
    best = scores.where("rank = 1").select("query_id", F.col("bucket_id").alias("_b"), "score")
    found = F.coalesce(F.col("score") >= c.threshold, F.lit(False))
    rows = signals.select("query_id").distinct().join(best, "query_id", "left")
    return rows.select("query_id", F.when(found, F.col("_b").cast("string")).otherwise(F.concat(F.lit("bucket_"), F.col("query_id").cast("string"))).alias("bucket_id"), (~found).alias("created"), "score", F.when(found, "matched_existing_bucket").otherwise("created_new_bucket").alias("route_reason"))


# --- signals and buckets ------------------------------------------------------------------------------------------------


def proposing(conclusions: DataFrame) -> DataFrame:
    return conclusions.where(F.col("conclusion").isin(*PROPOSING))


def build_signals(conclusions: DataFrame, blocks: DataFrame) -> DataFrame:
    """conclusions (doc_ref, block_id, conclusion, reason) with their blocks (doc_ref, block_id, text, tree) as signals.
    A conclusion about no block is an error on its row."""
    rows = conclusions.join(blocks, ["doc_ref", "block_id"], "left")
    missing = F.raise_error(F.concat(F.lit("conclusion about a missing block: "), F.col("block_id").cast("string"))).cast("string")
    return rows.withColumn("text", F.coalesce("text", missing)).select(
        T.signal_id(F.col("doc_ref").cast("string"), F.col("block_id").cast("string"), F.col("conclusion")).alias("signal_id"), "doc_ref", "block_id", "conclusion", "reason", "text", "tree", F.array_join(F.concat("tree", F.array("text")), "\n").alias("source_embedding_text"), F.col("reason").alias("reason_embedding_text")
    )


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, order).alias("_r")).select("_r.*")


def upserted(state: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """state with the rows of news in place of those of the same key."""
    return state.join(news.select(key).distinct(), key, "left_anti").unionByName(news)


def support(members: DataFrame) -> DataFrame:
    """(bucket_id, signals, docs) of members (bucket_id, signal_id, doc_ref): distinct ones."""
    return members.groupBy("bucket_id").agg(F.countDistinct("signal_id").alias("signals"), F.countDistinct("doc_ref").alias("docs"))


def eligible(buckets: DataFrame, min_docs: int = 2, min_signals: int = 5) -> DataFrame:
    """Buckets (status, docs, signals) that may be proposed; they are stable from then on."""
    fit = (F.col("docs") >= min_docs) & (F.col("signals") >= min_signals) & F.col("status").isin("incubating", "stable")
    return buckets.where(fit).withColumn("status", F.lit("stable"))


def bucket_states(mappings: DataFrame, signals: DataFrame) -> DataFrame:
    """(bucket_id, members, signals, docs, created_at, updated_at) of mappings (signal_id, bucket_id, assigned_at), of which
    each signal's last one counts, and signals (signal_id, doc_ref)."""
    last = latest(mappings, "signal_id", F.struct("assigned_at", "bucket_id"))
    rows = last.select("signal_id", "bucket_id", "assigned_at").join(signals.select("signal_id", "doc_ref").distinct(), "signal_id", "left")
    return rows.groupBy("bucket_id").agg(F.sort_array(F.collect_set("signal_id")).alias("members"), F.countDistinct("signal_id").alias("signals"), F.countDistinct("doc_ref").alias("docs"), F.min("assigned_at").alias("created_at"), F.max("assigned_at").alias("updated_at"))


def of_bucket(rows: DataFrame, bucket_id: str) -> DataFrame:
    """Mappings or proposals of one bucket."""
    return rows.where(F.col("bucket_id") == bucket_id)
