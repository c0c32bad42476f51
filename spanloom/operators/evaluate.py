"""Gold against predicted extractions: matching, precision and recall, diagnostics, error buckets, comparisons.

Both sides are rows (doc_id, idx, class, text, attributes map<string,string>, and for predictions alignment_status).
Strict metrics never build pairs: equal texts form complete bipartite graphs, so the matched number of each key is the
lesser of its two counts. Other metrics fold each document's rows: texts meet on shared tokens, are verified, and each
small component is solved exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from spanloom.functions import text as T
from spanloom.operators import schema as S
from spanloom.sources import shared

#: Fixed values of the relaxed text match, and the metrics' names.
THRESHOLDS = {"text_relaxed_f1": 0.8, "substring_precision": 0.8, "substring_recall": 0.8, "lccs_ratio": 0.7}
#: Fixed values of the comparison's verdicts: better, worse, little change; and of the core metric.
VERDICTS = ("candidate 相比 baseline 呈现明确提升", "candidate 相比 baseline 存在回归风险", "candidate 相比 baseline 变化有限")
CORE = ("核心结构化指标提升", "核心结构化指标退化", "核心结构化指标持平")
METRICS = ("detection_strict", "detection_relaxed", "class_strict", "class_relaxed", "structured_strict", "structured_relaxed")
#: Metrics that need a matching, and the kind of pairs each matches.
MATCHED = {"structured_strict": "strict", "detection_relaxed": "relaxed", "class_relaxed": "relaxed", "structured_relaxed": "relaxed"}


def normalised(rows: DataFrame, compatibility: bool = True) -> DataFrame:
    """rows with norm, the normal text, and norm_attributes."""
    return rows.withColumn("norm", T.normal_text(F.col("text"), compatibility)).withColumn("norm_attributes", T.normal_attributes(F.col("attributes"), compatibility))


def totals(pred: DataFrame, gold: DataFrame, docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, by..., n_pred, n_gold) for each document scored."""
    side = lambda x, n: x.groupBy("doc_id", *by).agg(F.count("*").alias(n))
    both = side(pred, "n_pred").join(side(gold, "n_gold"), ["doc_id", *by], "full_outer")
    out = docs.select("doc_id").distinct().join(both, "doc_id", "inner" if by else "left")
    return out.select("doc_id", *by, F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"))


def strict_tp(pred: DataFrame, gold: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(doc_id, keys..., tp): the bag intersection of both sides over doc_id, norm and the keys."""
    side = lambda x, n: x.groupBy("doc_id", "norm", *keys).agg(F.count("*").alias(n))
    return side(pred, "p").join(side(gold, "g"), ["doc_id", "norm", *keys]).groupBy("doc_id", *keys).agg(F.sum(F.least("p", "g")).alias("tp"))


# --- relaxed and structured matching ------------------------------------------------------------------------------------


#: Rows that a fold turns into Python objects at once, and edges in one batch that it gives.
SLICE_ROWS, BATCH_EDGES = 1000, 4096
#: Pairs of texts of a document that are all verified, as ordering tokens would take longer.
FEW_PAIRS = 64


def _by_document(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Both sides' rows, those of a document one after another in one partition."""
    side = lambda x, p: x.where("doc_id IS NOT NULL").select("doc_id", F.lit(p).alias("is_pred"), "idx", "class", "norm", "norm_attributes")
    return side(pred, True).unionByName(side(gold, False)).repartition("doc_id").sortWithinPartitions("doc_id", "is_pred", "idx")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], list[tuple]]]:
    """(doc_id, predictions, gold) of the documents that have both; rows are (idx, class, norm, attributes)."""
    doc, sides = None, ([], [])
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for own, is_pred, *row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                if own != doc:
                    if all(sides):
                        yield doc, *sides
                    doc, sides = own, ([], [])
                sides[not is_pred].append(row)
    if all(sides):
        yield doc, *sides


def _text_pairs(preds: Iterable[str], golds: Iterable[str], tau: dict[str, float]) -> Iterator[tuple[str, str, float]]:
    """(prediction, gold, F1) of the different texts of one document that match relaxed.

    Matching texts share more than `share` of the longer one's tokens. With each text's numbered tokens in one order for
    all, those of the fewest texts first, they then have one of their first n - ceil(n * share) + 1 in common."""
    share = min(tau["text_relaxed_f1"] / (2 - tau["text_relaxed_f1"]), tau["substring_precision"], tau["substring_recall"])
    split, bounds = re.compile(T.EVAL_TOKENS).findall, (tau["text_relaxed_f1"], tau["substring_precision"], tau["substring_recall"], tau["lccs_ratio"])
    preds, golds = sorted(set(preds)), sorted(set(golds))
    tokens = {x: split(x) for x in (*preds, *golds)}
    bags = {x: Counter(t) for x, t in tokens.items()}
    sizes = {x: len(t) for x, t in tokens.items()}

    def met() -> Iterator[tuple[str, Iterable[str]]]:
        if len(preds) * len(golds) <= FEW_PAIRS:
            yield from ((x, golds) for x in preds)
            return
        texts_with = Counter(chain.from_iterable(bags.values()))
        rank = {t: k for k, t in enumerate(sorted(sorted(texts_with), key=texts_with.__getitem__))}

        def first(x: str) -> list[int]:
            need = sizes[x] - math.ceil(sizes[x] * share - 1e-9) + 1
            every = (r + k * len(rank) for r, t in sorted((rank[t], t) for t in bags[x]) for k in range(bags[x][t]))
            return list(islice(every, max(need, 0)))

        heads, with_token = {x: first(x) for x in tokens}, {}
        for y in golds:
            for t in heads[y]:
                with_token.setdefault(t, []).append(y)
        for x in preds:
            yield x, sorted({y for t in heads[x] for y in with_token.get(t, ())})

    for x, found in met():
        n = sizes[x]
        for y in found:
            m = sizes[y]
            if min(n, m) >= share * max(n, m) - 1e-6 and (f := T.relaxed_weight(y, x, tokens[y], tokens[x], bags[y], bags[x], *bounds)) is not None:
                yield x, y, f


def _fits(p: dict | None, g: dict | None, ignored: tuple[str, ...]) -> bool | None:
    """normal_attributes_within of one pair."""
    if p is None:
        return None
    keys = [k for k in p if k not in ignored]
    return all(k in g and g[k] == p[k] for k in keys) if g is not None or not keys else None


def _row_pairs(preds: list[tuple], golds: list[tuple], relaxed: bool, tau: dict[str, float], ignored: tuple[str, ...]) -> Iterator[tuple[int, int, bool | None, bool | None, float]]:
    """(prediction's row, gold row, same_class, attributes_ok, weight) of one document's pairs whose texts match."""
    at: tuple[dict[str, list[int]], ...] = ({}, {})
    for rows, own in zip((preds, golds), at, strict=True):
        for k, (_, _, norm, _) in enumerate(rows):
            if norm is not None:
                own.setdefault(norm, []).append(k)
    maps = [[None if r[3] is None else dict(r[3]) for r in rows] for rows in (preds, golds)]
    for x, y, weight in _text_pairs(*at, tau) if relaxed else ((x, x, 1.0) for x in at[0] if x in at[1]):
        for i, j in product(at[0][x], at[1][y]):
            p, g = preds[i][1], golds[j][1]
            yield i, j, None if p is None or g is None else p == g, _fits(maps[0][i], maps[1][j], ignored), weight


def _folded(pred: DataFrame, gold: DataFrame, fold: Callable[[list[tuple], list[tuple]], Iterator[tuple]], columns: list[StructField]) -> DataFrame:
    """(doc_id, pred_idx, gold_idx, class, columns...) by a fold over each document's rows. It gives (prediction's row,
    gold row, values...); the class is the gold one's. Texts go to Python once, however many pairs they are in."""
    rows = _by_document(pred, gold)
    own = [StructField("doc_id", rows.schema["doc_id"].dataType), StructField("pred_idx", pred.schema["idx"].dataType), StructField("gold_idx", gold.schema["idx"].dataType), StructField("class", gold.schema["class"].dataType)]
    schema = StructType([*own, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, out = to_arrow_schema(schema), []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for doc, preds, golds in _documents(batches):
            for i, j, *values in fold(preds, golds):
                out.append((doc, preds[i][0], golds[j][0], golds[j][1], *values))
                if len(out) >= BATCH_EDGES:
                    yield give()
                    out = []
        if out:
            yield give()

    return rows.mapInArrow(run, schema)


def legal_pairs(pred: DataFrame, gold: DataFrame, *, relaxed: bool, thresholds: dict[str, float] | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pred_idx, gold_idx, class, same_class, attributes_ok, weight) of the pairs whose texts match. ignored:
    attribute keys that the domain's policy doesn't score.

    Strict ones share the normal text. The thresholds of the substring tests are swapped against their names as the rules
    pass the prediction first; only unequal ones tell."""
    tau = THRESHOLDS | (thresholds or {})
    columns = [StructField("same_class", BooleanType()), StructField("attributes_ok", BooleanType()), StructField("weight", DoubleType())]
    return _folded(pred, gold, lambda preds, golds: _row_pairs(preds, golds, relaxed, tau, ignored), columns)


def _assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """A matching of greatest weight; entries of 0 are no edges. Shortest augmenting paths with potentials."""
    turned = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if turned else weight)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while owner[at]:
            seen[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            to = int(np.where(seen[1:], np.inf, least[1:]).argmin()) + 1
            step = least[to]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            at = to
        while at:
            owner[at], at = owner[back[at]], back[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) if turned else (a, b) for a, b in pairs if weight[(b, a) if turned else (a, b)] > 0]


def _matched(pred: np.ndarray, gold: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which edges of one group are matched, component by component."""
    p, g = np.unique(pred, return_inverse=True)[1], np.unique(gold, return_inverse=True)[1]
    n, m = (int(x.max()) + 1 if len(x) else 0 for x in (p, g))
    if n == m == len(p):  # no two edges share an end
        return np.ones(n, dtype=bool)
    parent = list(range(n + m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(p.tolist(), g.tolist(), strict=True):
        a, b = root(x), root(n + y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    of = np.array([root(x) for x in p.tolist()], dtype=np.int64)
    order = np.argsort(of, kind="stable")
    out = np.zeros(len(p), dtype=bool)
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(p) else ():
        if len(part) == 1:
            out[part] = True
            continue
        rows, r = np.unique(p[part], return_inverse=True)
        cols, c = np.unique(g[part], return_inverse=True)
        dense = np.zeros((len(rows), len(cols)))
        dense[r, c] = weight[part]
        chosen = set(_assign(dense))
        out[part] = [(a, b) in chosen for a, b in zip(r.tolist(), c.tolist(), strict=True)]
    return out


def _match(edges: pd.DataFrame) -> pd.DataFrame:
    """The matched edges of one group."""
    return edges[_matched(edges["pred_idx"].to_numpy(), edges["gold_idx"].to_numpy(), edges["weight"].to_numpy())]


def matches(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The one-to-one matching of greatest weight among the pairs of each document (and each `by`)."""
    return pairs.groupBy("doc_id", *by).applyInPandas(_match, pairs.schema)


def metric_pairs(pairs: DataFrame, metric: str, by_class: bool = False) -> DataFrame:
    """Of the pairs whose texts match those that a metric may match."""
    kind = metric.split("_")[0]
    pairs = pairs.where("same_class") if kind != "detection" or by_class else pairs
    return pairs.where("attributes_ok") if kind == "structured" else pairs


def document_counts(pred: DataFrame, gold: DataFrame, docs: DataFrame, metric: str, *, by_class: bool = False, thresholds: dict[str, float] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id[, class], metric, tp, fp, fn). By class, only extractions of one class are matched with each other.

    pairs: legal_pairs of the metric's kind of text match, if already at hand."""
    by = ("class",) if by_class else ()
    if metric in ("detection_strict", "class_strict"):
        tp = strict_tp(pred, gold, ("class",) if by_class or metric == "class_strict" else ())
        tp = tp.groupBy("doc_id", *by).agg(F.sum("tp").alias("tp"))
    else:
        pairs = pairs if pairs is not None else legal_pairs(pred, gold, relaxed=metric.endswith("relaxed"), thresholds=thresholds)
        tp = matches(metric_pairs(pairs, metric, by_class), by).groupBy("doc_id", *by).agg(F.count("*").alias("tp"))
    rows = totals(pred, gold, docs, by).join(tp, ["doc_id", *by], "left").withColumn("tp", F.coalesce("tp", F.lit(0)).cast("long"))
    return rows.select("doc_id", *by, F.lit(metric).alias("metric"), "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))


def matched_edges(pred: DataFrame, gold: DataFrame, *, metrics: tuple[str, ...] = METRICS, thresholds: dict[str, float] | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pred_idx, gold_idx, class, and for each metric of MATCHED whether the pair is matched by it) of all pairs
    that any of those metrics matches. Pairs are made once, and one call matches all metrics of a document."""
    asked, tau = [m for m in MATCHED if m in metrics], THRESHOLDS | (thresholds or {})

    def fold(preds: list[tuple], golds: list[tuple]) -> Iterator[tuple]:
        flags: dict[tuple[int, int], list[bool]] = {}
        for kind in sorted({MATCHED[m] for m in asked}):
            wanted = [m for m in asked if MATCHED[m] == kind]
            pairs = _row_pairs(preds, golds, kind == "relaxed", tau, ignored)
            pairs = list(pairs if any(m.startswith("detection") for m in wanted) else (x for x in pairs if x[2]))
            for m in wanted:
                own = [x for x in pairs if (x[2] or m.startswith("detection")) and (x[3] or not m.startswith("structured"))]
                p, g = np.array([preds[x[0]][0] for x in own]), np.array([golds[x[1]][0] for x in own])
                for (i, j, *_), found in zip(own, _matched(p, g, np.array([x[4] for x in own])).tolist(), strict=True):
                    if found:
                        flags.setdefault((i, j), [False] * len(MATCHED))[list(MATCHED).index(m)] = True
        for (i, j), found in flags.items():
            yield i, j, *found

    return _folded(pred, gold, fold, [StructField(m, BooleanType()) for m in MATCHED])


def all_counts(pred: DataFrame, gold: DataFrame, docs: DataFrame, edges: DataFrame, metrics: tuple[str, ...] = METRICS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, metric, tp, fp, fn) and (doc_id, class, metric, tp, fp, fn) of all metrics over edges of matched_edges.

    By class, extractions are only matched with those of their class: that makes detection the class metric there."""
    side = lambda x, p, g: x.select("doc_id", "norm", "class", F.lit(p).alias("p"), F.lit(g).alias("g"))
    texts = side(pred, 1, 0).unionByName(side(gold, 0, 1)).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id", "norm", "class").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    of = lambda m: F.sum(F.col(m).cast("long")).alias(m)
    found = edges.groupBy("doc_id", "class").agg(*map(of, MATCHED))
    by_class = texts.groupBy("doc_id", "class").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.least("p", "g")).alias("class_strict"))
    by_class = by_class.join(found, ["doc_id", "class"], "left")
    strict = texts.groupBy("doc_id", "norm").agg(F.sum("p").alias("p"), F.sum("g").alias("g")).groupBy("doc_id").agg(F.sum(F.least("p", "g")).alias("detection_strict"))
    whole = by_class.groupBy("doc_id").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), *(F.sum(c).alias(c) for c in ("class_strict", "class_relaxed", "structured_strict", "structured_relaxed")))
    crossed = edges.groupBy("doc_id").agg(of("detection_relaxed"))
    whole = whole.join(strict, "doc_id", "left").join(crossed, "doc_id", "left")
    by_class = by_class.drop("detection_relaxed").withColumn("detection_strict", F.col("class_strict")).withColumn("detection_relaxed", F.col("class_relaxed"))

    def long(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0)).cast("long").alias("tp")) for m in metrics)))
        return rows.select(*keys, "p", "g", each.alias("_m")).select(*keys, "_m.metric", "_m.tp", (F.col("p") - F.col("_m.tp")).alias("fp"), (F.col("g") - F.col("_m.tp")).alias("fn"))

    return long(whole, ("doc_id",)), long(by_class, ("doc_id", "class"))


def _scores(digits: int | None) -> tuple[Column, Column, Column]:
    p, r = T.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), T.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    out = [F.round(x, digits) if digits is not None else x for x in (p, r, f1)]
    return out[0].alias("precision"), out[1].alias("recall"), out[2].alias("f1")


def micro(counts: DataFrame, by: tuple[str, ...] = ("metric",), digits: int | None = None) -> DataFrame:
    """Sums, then ratios; 0 where there is nothing to divide by."""
    sums = counts.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return sums.select(*by, *_scores(digits), "tp", "fp", "fn")


def macro(counts: DataFrame, by: tuple[str, ...] = ("metric",), digits: int | None = None) -> DataFrame:
    """Means of the documents' ratios, of their F1 too; counts are summed."""
    each = counts.select(*by, *_scores(None), "tp", "fp", "fn")
    mean = lambda c: (F.round(F.avg(c), digits) if digits is not None else F.avg(c)).alias(c)
    return each.groupBy(*by).agg(mean("precision"), mean("recall"), mean("f1"), *(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))


# --- diagnostics --------------------------------------------------------------------------------------------------------


def grounding(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., status, numerator, denominator, value) for each status, unknown ones as none."""
    named = pred.withColumn("_s", T.status_name(F.col("alignment_status")))
    counts = named.groupBy(*by).agg(F.count("*").alias("denominator"), *(F.sum((F.col("_s") == s).cast("long")).alias(s) for s in T.STATUSES))
    long = counts.select(*by, "denominator", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.coalesce(s, F.lit(0)).cast("long").alias("numerator")) for s in T.STATUSES))).alias("_x"))
    return long.select(*by, "_x.status", "_x.numerator", "denominator", T.safe_ratio(F.col("_x.numerator"), F.col("denominator")).alias("value"))


def anomalies(pred: DataFrame, domain: S.Domain = S.DEFAULT) -> DataFrame:
    """pred with reasons: why an extraction breaks the schema, empty if it doesn't. A wrong class is the only reason
    then; a wrong key hides its value."""
    allowed, keys, values = domain.columns(F.col("class"))
    entries = F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>")))

    def reason(e: Column) -> Column:
        listed = F.element_at(values, e["key"])
        return F.when(~F.array_contains(keys, e["key"]), F.concat(F.lit("illegal_attribute_key:"), e["key"])).when(listed.isNotNull() & ~F.array_contains(listed, F.coalesce(e["value"], F.lit("None"))), F.concat(F.lit("illegal_attribute_value:"), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))

    found = F.filter(F.transform(entries, reason), lambda x: x.isNotNull())
    return pred.withColumn("reasons", F.when(~allowed, F.array(F.concat(F.lit("unsupported_class:"), F.coalesce("class", F.lit("None"))))).otherwise(F.coalesce(found, F.array().cast("array<string>"))))


def anomaly_rate(pred: DataFrame, by: tuple[str, ...] = (), domain: S.Domain = S.DEFAULT) -> DataFrame:
    bad = (F.size("reasons") > 0).cast("long")
    return anomalies(pred, domain).groupBy(*by).agg(F.sum(bad).alias("numerator"), F.count("*").alias("denominator")).withColumn("value", T.safe_ratio(F.col("numerator"), F.col("denominator")))


def anomaly_samples(pred: DataFrame, most: int = 20, domain: S.Domain = S.DEFAULT) -> DataFrame:
    """The first anomalies of each document."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return anomalies(pred, domain).where(F.size("reasons") > 0).withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn")


# --- error buckets ------------------------------------------------------------------------------------------------------


def duplicates(pred: DataFrame) -> DataFrame:
    """(doc_id, idx, first_idx): repeats of a prediction's class, text and attributes."""
    key = Window.partitionBy("doc_id", "class", "text", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))))).orderBy("idx")
    return pred.withColumn("first_idx", F.first("idx").over(key)).where("idx <> first_idx").select("doc_id", "idx", "first_idx")


def error_buckets(pred: DataFrame, gold: DataFrame, docs: DataFrame, thresholds: dict[str, float] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(bucket, doc_id, pred_idx, gold_idx). Drift and class errors are the same set by their definitions.

    edges: of matched_edges with the relaxed metrics; made and written here if not at hand, as five buckets read them."""
    relaxed = ("detection_relaxed", "class_relaxed", "structured_relaxed")
    edges = edges if edges is not None else shared.written(matched_edges(pred, gold, metrics=relaxed, thresholds=thresholds), "edges")
    d, c, s = (edges.where(m).select("doc_id", "pred_idx", "gold_idx") for m in relaxed)
    null = F.lit(None).cast("int")
    scored = docs.select("doc_id").distinct()
    miss = gold.join(scored, "doc_id", "left_semi").select("doc_id", F.col("idx").alias("gold_idx")).join(d, ["doc_id", "gold_idx"], "left_anti").select(F.lit("miss").alias("bucket"), "doc_id", null.alias("pred_idx"), "gold_idx")
    spurious = pred.select("doc_id", F.col("idx").alias("pred_idx")).join(d, ["doc_id", "pred_idx"], "left_anti").select(F.lit("spurious").alias("bucket"), "doc_id", "pred_idx", null.alias("gold_idx"))
    again = duplicates(pred).select(F.lit("duplicate").alias("bucket"), "doc_id", F.col("idx").alias("pred_idx"), null.alias("gold_idx"))
    wrong = d.join(c, ["doc_id", "pred_idx", "gold_idx"], "left_anti")
    unlike = c.join(s, ["doc_id", "pred_idx", "gold_idx"], "left_anti").select(F.lit("attribute_error").alias("bucket"), "doc_id", "pred_idx", "gold_idx")
    both = wrong.select(F.explode(F.array(F.lit("text_drift"), F.lit("class_error"))).alias("bucket"), "doc_id", "pred_idx", "gold_idx")
    return miss.unionByName(spurious).unionByName(again).unionByName(both).unionByName(unlike)


def bucket_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("bucket").agg(F.count("*").alias("n"))


def error_samples(errors: DataFrame, most: int = 50) -> DataFrame:
    """The first entries in order of documents and buckets."""
    return errors.orderBy("doc_id", "bucket", F.coalesce("pred_idx", F.lit(-1)), F.coalesce("gold_idx", F.lit(-1))).limit(most)


# --- comparison ---------------------------------------------------------------------------------------------------------


def deltas(baseline: DataFrame, candidate: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], digits: int | None = None) -> DataFrame:
    """Full outer: each value of both sides (0 where a side has no such key) and what it changed by."""
    a, b = (x.select(*keys, *(F.col(v).alias(f"{s}_{v}") for v in values)) for x, s in ((baseline, "baseline"), (candidate, "candidate")))
    both = a.join(b, list(keys), "full_outer").fillna(0)
    change = lambda v: F.col(f"candidate_{v}") - F.col(f"baseline_{v}")
    return both.select(*keys, *(f"{s}_{v}" for v in values for s in ("baseline", "candidate")), *((F.round(change(v), digits) if digits is not None else change(v)).alias(f"{v}_delta") for v in values))


def regression_summary(metrics: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: how many deltas improved, degraded or stayed, and two verdicts on the structured metrics.

    metrics: metric, f1_delta; diagnostics: metric, value_delta. Of the diagnostics only the anomaly rate counts as
    better when it falls."""
    rate = F.col("metric") == "structure_anomaly_rate"
    every = metrics.select("metric", F.col("f1_delta").alias("d")).unionByName(diagnostics.select("metric", F.when(rate, -F.col("value_delta")).otherwise(F.col("value_delta")).alias("d")))
    of = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("d"))), F.lit(0.0))
    row = every.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("improved_metric_count", F.col("d") > 0), ("degraded_metric_count", F.col("d") < 0), ("unchanged_metric_count", F.col("d") == 0))), of("structured_relaxed").alias("_r"), of("structured_strict").alias("_s"), of("structure_anomaly_rate").alias("_a"))
    overall = F.when((F.col("_r") > 0) & (F.col("_s") >= 0) & (F.col("_a") >= 0), VERDICTS[0]).when((F.col("_r") < 0) | (F.col("_s") < 0), VERDICTS[1]).otherwise(VERDICTS[2])
    core = F.when(F.col("_r") > 0, CORE[0]).when(F.col("_r") < 0, CORE[1]).otherwise(CORE[2])
    return row.select(overall.alias("overall_assessment"), core.alias("core_metric_assessment"), "improved_metric_count", "degraded_metric_count", "unchanged_metric_count")


# --- validation ---------------------------------------------------------------------------------------------------------


def dataset_problems(docs: DataFrame) -> DataFrame:
    """(doc_id, problem) of documents (doc_id, domain): repeated ids, missing domains."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate_doc_id").alias("problem"))
    return again.unionByName(docs.where(F.coalesce("domain", F.lit("")) == "").select("doc_id", F.lit("missing_domain").alias("problem")))


def gold_problems(gold: DataFrame, docs: DataFrame, domain: S.Domain = S.DEFAULT) -> DataFrame:
    """(doc_id, idx, problem): documents without extractions, missing required keys, illegal keys."""
    allowed, keys, _ = domain.columns(F.col("class"))
    own = F.map_keys(F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    listed = gold.where(allowed).select("doc_id", "idx", F.explode(F.concat(F.transform(F.array_except(domain.required(F.col("class")), own), lambda k: F.concat(F.lit("missing_attribute:"), k)), F.transform(F.array_except(own, keys), lambda k: F.concat(F.lit("illegal_attribute_key:"), k)))).alias("problem"))
    none = docs.select("doc_id").distinct().join(gold, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("idx"), F.lit("no_extractions").alias("problem"))
    return listed.unionByName(none)


def prediction_problems(pred: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, idx, problem): predictions of unknown documents, blank texts, blank classes."""
    unknown = pred.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "idx", F.lit("unknown_doc_id").alias("problem"))
    blank = lambda c, p: pred.where(F.trim(F.coalesce(c, F.lit(""))) == "").select("doc_id", "idx", F.lit(p).alias("problem"))
    return unknown.unionByName(blank("text", "blank_text")).unionByName(blank("class", "blank_class"))


def scored_documents(pred: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gold documents that have predictions, which alone are scored, and one row of how many that leaves out."""
    of = gold.select("doc_id").distinct()
    docs = of.join(pred.select("doc_id").distinct(), "doc_id", "left_semi")
    return docs, of.join(docs.withColumn("_in", F.lit(1)), "doc_id", "left").agg(F.count("*").alias("gold_docs"), F.count("_in").alias("scored_docs"))


def report_lines(rows: list) -> Iterator[str]:
    """Metric rows as console lines with six decimals."""
    for r in sorted(rows, key=lambda r: METRICS.index(r["metric"]) if r["metric"] in METRICS else 99):
        yield f"{r['metric']}: precision={r['precision']:.6f} recall={r['recall']:.6f} f1={r['f1']:.6f} tp={r['tp']} fp={r['fp']} fn={r['fn']}"
