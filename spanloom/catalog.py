"""Registered queries over the driver's tables, and the same results in SQL.

Inputs that the tables don't hold (gold and predicted extractions, spans, Markdown, signals) are derived from them by the
same expressions on both sides. A query without SQL is held against a plain loop in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import parsing as P
from spanloom.functions import text as T
from spanloom.operators import chunks as C
from spanloom.operators import evaluate as E
from spanloom.operators import evolve as V
from spanloom.operators import inference as N
from spanloom.operators import intervals as I
from spanloom.operators import residual as R
from spanloom.operators import tokens as K
from spanloom.operators.align import align_rows
from spanloom.plans import evaluation, extraction
from spanloom.sources import scans, shared, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- derived inputs -----------------------------------------------------------------------------------------------------

_GOLD = """SELECT conv_id AS doc_id, CAST(turn AS INT) AS idx, CASE turn % 3 WHEN 0 THEN 'goal' WHEN 1 THEN 'risk' ELSE 'definition' END AS class, text,
  CASE WHEN turn % 3 = 2 AND conv_id % 5 <> 0 THEN CASE WHEN turn % 2 = 0 THEN 'term' ELSE 'unheard' END END AS kind, turn FROM conversations"""
_DISTORTED = "CASE WHEN turn % 5 = 0 THEN lower(text) WHEN turn % 4 = 3 THEN substr(text, 1, greatest(length(text) - 10, 1)) ELSE text END"
_PRED = f"""SELECT doc_id, idx, CASE WHEN turn % 6 = 5 THEN 'risk' WHEN turn % 11 = 10 THEN 'tale' ELSE class END AS class,
  {_DISTORTED} AS text, kind,
  CASE turn % 4 WHEN 0 THEN 'match_exact' WHEN 1 THEN ' Match_Lesser ' WHEN 2 THEN 'match_fuzzy' END AS alignment_status, turn FROM ({_GOLD}) g WHERE turn % 7 <> 3
UNION ALL SELECT doc_id, idx + 1000, class, text, kind, 'match_exact', turn FROM ({_GOLD}) g WHERE turn % 5 = 1"""
#: The evaluation's normal text without compatibility forms.
_NORM = r"""lower(trim(regexp_replace(regexp_replace({0}, '\\+"', '"', 'g'), '\s+', ' ', 'g')))"""
_SPANS = """SELECT doc_id, k AS span_id, CAST((doc_id * 37 + k * 211) % greatest(n, 1) AS INT) AS "start", CAST(least(n, (doc_id * 37 + k * 211) % greatest(n, 1) + 20 + (doc_id * 13 + k * 7) % 80) AS INT) AS "end"
FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) d, range(0, 6) r(k)"""
_SIGNALS = "SELECT event_id, user_id % 10 AS bucket_id, event_type AS doc_ref, user_id AS signal_id, ts, CASE event_id % 3 WHEN 0 THEN 'new_schema' WHEN 1 THEN 'new_attr' ELSE 'noise' END AS conclusion FROM events"


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), t.cast("int").alias("idx"), F.when(t % 3 == 0, "goal").when(t % 3 == 1, "risk").otherwise("definition").alias("class"), "text", F.when((t % 3 == 2) & (F.col("conv_id") % 5 != 0), F.when(t % 2 == 0, "term").otherwise("unheard")).alias("kind"), t)
    return rows.withColumn("attributes", F.when(F.col("kind").isNotNull(), F.create_map(F.lit("definition_type"), F.col("kind"))))


def _distorted() -> Column:
    t, x = F.col("turn"), F.col("text")
    return F.when(t % 5 == 0, F.lower(x)).when(t % 4 == 3, F.substring(x, F.lit(1), F.greatest(F.length(x) - 10, F.lit(1)))).otherwise(x)


def pred_rows(spark: SparkSession, sf: str) -> DataFrame:
    gold, t, text = gold_rows(spark, sf), F.col("turn"), _distorted()
    status = F.when(t % 4 == 0, "match_exact").when(t % 4 == 1, " Match_Lesser ").when(t % 4 == 2, "match_fuzzy")
    cls = F.when(t % 6 == 5, "risk").when(t % 11 == 10, "tale").otherwise(F.col("class"))
    first = gold.where(t % 7 != 3).withColumn("class", cls).withColumn("text", text).withColumn("alignment_status", status)
    return first.unionByName(gold.where(t % 5 == 1).withColumn("idx", F.col("idx") + 1000).withColumn("alignment_status", F.lit("match_exact")))


def span_rows(spark: SparkSession, sf: str) -> DataFrame:
    k, n, d = F.col("span_id"), F.col("_n"), F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("span_id"))
    at = (d * 37 + k * 211) % F.greatest(n, F.lit(1))
    return rows.select("doc_id", "span_id", at.cast("int").alias("start"), F.least(n, at + 20 + (d * 13 + k * 7) % 80).cast("int").alias("end"))


def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' lines under headings, with a list, a fence and a table between."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    parts = F.transform(lines, lambda x, k: F.concat(F.when(k % 4 == 0, F.concat(F.lit("\n## "), F.substring(x, 1, 20), F.lit("\n"))).when(k % 4 == 1, F.lit("- ")).when(k % 4 == 2, F.lit("\n")).otherwise(F.lit("### sub\n")), x, F.lit("\n")))
    whole = F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n\n## Contents\n- [a](#a)\n- [b](#b)\n\n"), F.array_join(parts, ""), F.lit("```\ncode # not a heading\n```\n| a | b |\n| 1 | 2 |\n"))
    return table(spark, sf, "documents").select("doc_id", whole.alias("text"))


def signal_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(e, (F.col("user_id") % 10).alias("bucket_id"), F.col("event_type").alias("doc_ref"), F.col("user_id").alias("signal_id"), "ts", F.when(e % 3 == 0, "new_schema").when(e % 3 == 1, "new_attr").otherwise("noise").alias("conclusion"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pred, gold = E.normalised(pred_rows(spark, sf), False), E.normalised(gold_rows(spark, sf), False)
    docs, _ = E.scored_documents(pred, gold)
    return pred, gold, docs


# --- evaluation ---------------------------------------------------------------------------------------------------------

_SIDES = f"""WITH gold AS (SELECT *, {_NORM.format('text')} AS norm FROM ({_GOLD}) g), pred AS (SELECT *, {_NORM.format('text')} AS norm FROM ({_PRED}) p),
docs AS (SELECT DISTINCT doc_id FROM gold WHERE doc_id IN (SELECT doc_id FROM pred))"""
_RATIOS = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"""


def _counts_sql(keys: str, by: str = "") -> str:
    """Documents' strict counts: keys of equality besides the text, and a grouping column."""
    k, b = (f", {keys}" if keys else ""), (f", {by}" if by else "")
    join = "".join(f" AND p.{x} = g.{x}" for x in keys.split(", ") if x)
    of = f", coalesce(p.{by}, g.{by}) AS {by}" if by else ""
    on = f" AND p.{by} = g.{by}" if by else ""
    tie = f" AND t.{by} = s.{by}" if by else ""
    return f"""{_SIDES},
pc AS (SELECT doc_id, norm{k}, count(*) AS n FROM pred GROUP BY ALL), gc AS (SELECT doc_id, norm{k}, count(*) AS n FROM gold GROUP BY ALL),
tp AS (SELECT p.doc_id{', p.' + by if by else ''}, sum(least(p.n, g.n)) AS tp FROM pc p JOIN gc g ON p.doc_id = g.doc_id AND p.norm = g.norm{join} GROUP BY ALL),
pn AS (SELECT doc_id{b}, count(*) AS n FROM pred GROUP BY ALL), gn AS (SELECT doc_id{b}, count(*) AS n FROM gold GROUP BY ALL),
s AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id{of}, coalesce(p.n, 0) AS np, coalesce(g.n, 0) AS ng FROM pn p FULL JOIN gn g ON p.doc_id = g.doc_id{on}),
counts AS (SELECT s.doc_id{', s.' + by if by else ''}, coalesce(t.tp, 0) AS tp, s.np - coalesce(t.tp, 0) AS fp, s.ng - coalesce(t.tp, 0) AS fn FROM s JOIN docs USING (doc_id) LEFT JOIN tp t ON t.doc_id = s.doc_id{tie})"""


def _micro_sql(metric: str, keys: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""{_counts_sql(keys, by)}, m AS (SELECT {b}sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY ALL), q AS (SELECT *, {_RATIOS} FROM m)
SELECT {b}'{metric}' AS metric, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, tp, fp, fn FROM q"""


@query(_micro_sql("detection_strict", ""))
def eval_detection_strict_micro(spark, sf):
    return E.micro(E.document_counts(*_sides(spark, sf), "detection_strict"), digits=6)


@query(_micro_sql("class_strict", "class"))
def eval_class_strict_micro(spark, sf):
    return E.micro(E.document_counts(*_sides(spark, sf), "class_strict"), digits=6)


@query(f"""{_counts_sql("")}, q AS (SELECT *, {_RATIOS} FROM counts)
SELECT 'detection_strict' AS metric, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM q""")
def eval_strict_macro_doc(spark, sf):
    return E.macro(E.document_counts(*_sides(spark, sf), "detection_strict"), digits=6)


@query(_micro_sql("detection_strict", "class", "class"))
def eval_strict_macro_class(spark, sf):
    return E.micro(E.document_counts(*_sides(spark, sf), "detection_strict", by_class=True), ("class", "metric"), digits=6)


@query(_micro_sql("detection_strict", ""))
def eval_detection_strict_nfkc(spark, sf):
    """With compatibility forms; the conversations hold none, so the SQL is that of the plain query."""
    pred, gold = (E.normalised(x) for x in (pred_rows(spark, sf), gold_rows(spark, sf)))
    return E.micro(E.document_counts(pred, gold, E.scored_documents(pred, gold)[0], "detection_strict"), digits=6)


@query()
def eval_all_micro(spark, sf):
    done = evaluation.evaluate(pred_rows(spark, sf), gold_rows(spark, sf), compatibility=False)
    return E.micro(done.documents, digits=6)


@query()
def eval_error_buckets(spark, sf):
    return E.bucket_counts(E.error_buckets(*_sides(spark, sf)))


@query()
def eval_error_samples(spark, sf):
    return E.error_samples(E.error_buckets(*_sides(spark, sf)))


@query(f"""WITH pred AS ({_PRED}), s AS (SELECT CASE WHEN lower(trim(alignment_status)) IN ('match_exact', 'match_lesser', 'match_fuzzy', 'match_none') THEN lower(trim(alignment_status)) ELSE 'match_none' END AS s FROM pred)
SELECT k AS status, sum((s = k)::INT)::BIGINT AS numerator, count(*)::BIGINT AS denominator, round(sum((s = k)::INT) / count(*), 6) AS value FROM s, (VALUES ('match_exact'), ('match_lesser'), ('match_fuzzy'), ('match_none')) v(k) GROUP BY k""")
def grounding_rates(spark, sf):
    return E.grounding(pred_rows(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"""SELECT doc_id, idx, CASE WHEN class NOT IN ('goal', 'risk', 'definition') THEN 'unsupported_class:' || class WHEN class <> 'definition' THEN 'illegal_attribute_key:definition_type' ELSE 'illegal_attribute_value:definition_type=' || kind END AS reason
FROM ({_PRED}) p WHERE class = 'tale' OR (kind IS NOT NULL AND class <> 'definition') OR (class = 'definition' AND kind = 'unheard')""")
def structure_anomalies(spark, sf):
    return E.anomalies(pred_rows(spark, sf)).select("doc_id", "idx", F.explode("reasons").alias("reason"))


@query(f"""WITH p AS (SELECT *, min(idx) OVER (PARTITION BY doc_id, class, text, kind) AS first_idx FROM ({_PRED}) p) SELECT doc_id, idx, first_idx FROM p WHERE idx <> first_idx""")
def duplicate_predictions(spark, sf):
    return E.duplicates(pred_rows(spark, sf))


@query(f"""WITH p AS (SELECT CASE WHEN turn % 13 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, idx, CASE WHEN turn % 9 = 0 THEN '  ' ELSE text END AS text FROM ({_PRED}) p)
SELECT doc_id, idx, 'unknown_doc_id' AS problem FROM p WHERE doc_id NOT IN (SELECT conv_id FROM conversations) UNION ALL SELECT doc_id, idx, 'blank_text' FROM p WHERE trim(text) = ''""")
def validate_predictions(spark, sf):
    p = pred_rows(spark, sf).withColumn("doc_id", F.when(F.col("turn") % 13 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))).withColumn("text", F.when(F.col("turn") % 9 == 0, "  ").otherwise(F.col("text")))
    return E.prediction_problems(p, gold_rows(spark, sf))


@query(f"""SELECT doc_id, idx, 'illegal_attribute_key:definition_type' AS problem FROM ({_GOLD}) g WHERE class <> 'definition' AND kind IS NOT NULL UNION ALL SELECT doc_id, idx, 'missing_attribute:definition_type' FROM ({_GOLD}) g WHERE class = 'definition' AND kind IS NULL""")
def validate_gold(spark, sf):
    return E.gold_problems(gold_rows(spark, sf), gold_rows(spark, sf))


@query(f"""WITH a AS (SELECT class, count(*)::BIGINT AS n FROM ({_GOLD}) g GROUP BY class), b AS (SELECT class, count(*)::BIGINT AS n FROM ({_PRED}) p GROUP BY class)
SELECT coalesce(a.class, b.class) AS class, coalesce(a.n, 0) AS baseline_n, coalesce(b.n, 0) AS candidate_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS n_delta FROM a FULL JOIN b ON a.class = b.class""")
def compare_class_deltas(spark, sf):
    count = lambda x: x.groupBy("class").agg(F.count("*").alias("n"))
    return E.deltas(count(gold_rows(spark, sf)), count(pred_rows(spark, sf)), ("class",), ("n",))


@query()
def compare_runs(spark, sf):
    gold, pred = gold_rows(spark, sf), pred_rows(spark, sf)
    better = gold.where(F.col("turn") % 7 != 3).withColumn("alignment_status", F.lit("match_exact"))
    return evaluation.compare(evaluation.evaluate(pred, gold, compatibility=False), evaluation.evaluate(better, gold, compatibility=False)).summary


@query(f"""WITH pairs AS (SELECT doc_id, idx, regexp_extract_all({_NORM.format('text')}, '[A-Za-z0-9_.:/-]+|\\S') AS a, regexp_extract_all({_NORM.format(_DISTORTED)}, '[A-Za-z0-9_.:/-]+|\\S') AS b FROM ({_GOLD}) g),
c AS (SELECT doc_id, idx, len(a) AS na, len(b) AS nb, list_sum(list_transform(list_distinct(b), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))) AS n FROM pairs)
SELECT doc_id, idx, coalesce(n, 0)::BIGINT AS shared, CASE WHEN na > 0 THEN round(coalesce(n, 0) / na, 6) ELSE 0 END AS over_a, CASE WHEN nb > 0 THEN round(coalesce(n, 0) / nb, 6) ELSE 0 END AS over_b FROM c""")
def token_overlap_pairs(spark, sf):
    """Each turn against its whole distorted text."""
    return _token_overlaps(gold_rows(spark, sf), _distorted())


def _token_overlaps(gold: DataFrame, other: Column) -> DataFrame:
    rows = gold.select("doc_id", "idx", T.eval_tokens(T.normal_text(F.col("text"), False)).alias("a"), T.eval_tokens(T.normal_text(other, False)).alias("b"))
    counts = rows.select("doc_id", "idx", T.bag_overlap(F.col("b"), F.col("a")).alias("n"), F.size("a").alias("na"), F.size("b").alias("nb"))
    return counts.select("doc_id", "idx", F.col("n").cast("long").alias("shared"), *(F.round(T.safe_ratio(F.col("n"), F.col(m)), 6).alias(o) for m, o in (("na", "over_a"), ("nb", "over_b"))))


# --- tokens, lines, chunks ----------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{Nd}+')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(t, '\p{Nd}+') THEN 1 ELSE 0 END AS kind, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def tokens_by_type(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t"))
    return rows.select("doc_id", T.token_kind(F.col("t")).alias("kind")).where(F.col("kind") != T.PUNCTUATION).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


#: The tokens of the documents by their pattern; runs of one symbol are joined by windows.
_TOKENS = r"""p AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+|\p{Nd}+|[\s\x0B\x{85}\p{Z}]+|(?s:.)') AS l FROM documents) x),
q AS (SELECT *, regexp_matches(t, '^[\s\x0B\x{85}\p{Z}]') AS sp, regexp_matches(t, '^[^\p{L}\p{M}\p{Nd}\s\x0B\x{85}\p{Z}]') AS sym, lag(t) OVER (PARTITION BY doc_id ORDER BY k) AS pt FROM p),
r AS (SELECT *, sum(CASE WHEN sym AND pt = t THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM q),
s AS (SELECT doc_id, g, string_agg(t, '' ORDER BY k) AS t, bool_or(sp) AS sp, bool_or(sym) AS sym FROM r GROUP BY doc_id, g),
u AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY g) AS e, lag(CASE WHEN sp THEN t END) OVER (PARTITION BY doc_id ORDER BY g) AS gap FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS idx FROM u WHERE NOT sp),
tok AS (SELECT doc_id, idx::INT AS idx, t AS token, CASE WHEN sym THEN 2 WHEN regexp_matches(t, '^\p{Nd}') THEN 1 ELSE 0 END AS kind, (e - length(t))::INT AS "start", e::INT AS "end", idx > 0 AND coalesce(regexp_matches(gap, '[\n\r]'), false) AS nl FROM v)"""
_SENTENCES = r"""e AS (SELECT *, kind = 2 AND regexp_matches(token, '[.?!。！？।]["''”’»)\]}]*$') AND coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY idx) || token, token) NOT IN ('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'St.') AS ends FROM tok),
c AS (SELECT *, kind = 2 AND token IN ('"', chr(39), '”', '’', '»', ')', ']', '}') AND NOT ends AS closes FROM e),
d AS (SELECT *, closes AND coalesce(last_value(CASE WHEN NOT closes THEN ends END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx), false) AS drawn FROM c),
l AS (SELECT *, (ends OR drawn OR coalesce(lead(nl AND NOT regexp_matches(token, '^\p{Ll}')) OVER w, false)) AND NOT coalesce(lead(drawn) OVER w, false) AS stops, lead(idx) OVER w IS NOT NULL AS inner_ FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""


@query(f'WITH {_TOKENS} SELECT doc_id, idx, token, kind, "start", "end", nl FROM tok')
def token_spans(spark, sf):
    return K.token_rows(table(spark, sf, "documents"))


@query(f"WITH {_TOKENS}, {_SENTENCES} SELECT doc_id, 1 + coalesce(sum((stops AND inner_)::INT), 0)::BIGINT AS sentences, count(*)::BIGINT AS tokens FROM l GROUP BY doc_id")
def sentences_per_doc(spark, sf):
    rows = K.token_rows(table(spark, sf, "documents"), sentences=True)
    return rows.groupBy("doc_id").agg((F.max("sentence") + 1).cast("long").alias("sentences"), F.count("*").alias("tokens"))


@query(f"""WITH {_TOKENS} SELECT x.doc_id, x.span_id, x."start", x."end", min(idx) AS first_token, (max(idx) + 1)::INT AS end_token FROM ({_SPANS}) x JOIN tok ON tok.doc_id = x.doc_id AND tok."start" < x."end" AND x."start" < tok."end" GROUP BY ALL""")
def spans_to_tokens(spark, sf):
    return K.spans_to_text_tokens(span_rows(spark, sf), table(spark, sf, "documents"))


@query(f"""SELECT s.doc_id, span_id, substr(text, "start" + 1, "end" - "start") AS span_text, regexp_replace(trim(substr(text, "start" + 1, "end" - "start")), '\\s+', ' ', 'g') <> '' AS filled
FROM ({_SPANS}) s JOIN documents d ON d.doc_id = s.doc_id""")
def span_texts(spark, sf):
    rows = span_rows(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    cut = T.span(F.col("text"), F.col("start"), F.col("end"))
    return rows.select("doc_id", "span_id", cut.alias("span_text"), (T.sanitize(cut) != "").alias("filled"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(line, '^\s*$') THEN 'blank' WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(line, '^\s*\d+[.)]\s+') THEN 'numbered_item' WHEN regexp_matches(line, '^\s*[-*+]\s+') THEN 'bullet_item' WHEN regexp_matches(line, '^\s*>') THEN 'blockquote' ELSE 'paragraph' END AS kind, count(*)::BIGINT AS n
FROM l WHERE line <> '' GROUP BY ALL""")
def line_kinds(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).where(F.col("line") != "\n")
    return rows.groupBy("doc_id", T.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query()
def chunks_sentence(spark, sf):
    return C.sentence_chunk_rows(table(spark, sf, "documents"), 1000)


@query()
def markdown_blocks(spark, sf):
    return C.block_rows(markdown_rows(spark, sf)).select("doc_id", "block", "kind", "level", "start", "end", "skip_reason")


@query()
def markdown_containers(spark, sf):
    return C.container_rows(markdown_rows(spark, sf)).select("doc_id", "container", "kind", "first_token", "end_token", F.size("members").alias("n_blocks"))


@query()
def chunks_markdown(spark, sf):
    return C.structured_chunk_rows(markdown_rows(spark, sf)).drop("containers")


@query()
def chunk_context_prev(spark, sf):
    return C.with_previous(C.sentence_chunk_rows(table(spark, sf, "documents"), 500), 100).select("doc_id", "chunk", "previous")


@query()
def chunk_batches(spark, sf):
    return C.batches(C.sentence_chunk_rows(table(spark, sf, "documents"), 1000).select("doc_id", "chunk"), 10).select("doc_id", "chunk", "batch")


# --- intervals and residual text ----------------------------------------------------------------------------------------

_MERGED = f"""WITH s AS (SELECT DISTINCT doc_id, "start", "end" FROM ({_SPANS}) x WHERE "start" < "end"),
m AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
merged AS (SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY doc_id, island)"""
_GAPS = f"""{_MERGED}, edges AS (SELECT doc_id, "start", "end" FROM merged UNION ALL SELECT doc_id, length(text), length(text) FROM documents),
g AS (SELECT doc_id, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, "start" AS b FROM edges)"""


@query(f'{_MERGED} SELECT doc_id, "start", "end" FROM merged')
def intervals_merged(spark, sf):
    return I.merged(I.clamp(span_rows(spark, sf), table(spark, sf, "documents")))


@query(f'{_GAPS} SELECT doc_id, a::INT AS "start", b::INT AS "end" FROM g WHERE a < b')
def residual_gaps(spark, sf):
    docs = table(spark, sf, "documents")
    return I.complement(I.merged(I.clamp(span_rows(spark, sf), docs)), docs)


@query(f"""{_MERGED}, c AS (SELECT doc_id, sum("end" - "start") AS n FROM merged GROUP BY doc_id)
SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, coalesce(c.n, 0)::BIGINT AS covered_chars, CASE WHEN length(d.text) > 0 THEN round(coalesce(c.n, 0) / length(d.text), 6) ELSE 0 END AS ratio FROM documents d LEFT JOIN c USING (doc_id)""")
def coverage_ratio(spark, sf):
    docs = table(spark, sf, "documents")
    return R.coverage(docs, I.merged(I.clamp(span_rows(spark, sf), docs)))


@query(f"""SELECT a.doc_id, a.span_id, b.span_id AS r_span_id FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.doc_id = b.doc_id AND a."start" < b."end" AND b."start" < a."end" WHERE a.span_id < b.span_id AND a."start" < a."end" AND b."start" < b."end" """)
def span_overlaps(spark, sf):
    spans = span_rows(spark, sf)
    right = spans.select("doc_id", F.col("span_id").alias("r_span_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.overlaps(spans, right).where("span_id < r_span_id").select("doc_id", "span_id", "r_span_id")


@query(f"""WITH e AS (SELECT doc_id, span_id, "start" AS pos, 'start' AS event, "start" - "end" AS k FROM ({_SPANS}) s WHERE "start" < "end" UNION ALL SELECT doc_id, span_id, "end", 'end', "end" - "start" FROM ({_SPANS}) s WHERE "start" < "end")
SELECT doc_id, span_id, pos, event, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, event, k, span_id) - 1)::INT AS ord FROM e""")
def highlight_events(spark, sf):
    return I.highlight_events(span_rows(spark, sf))


@query(f"""WITH t AS (SELECT doc_id, span_id, "start" AS "at" FROM ({_SPANS}) s), h AS (SELECT doc_id, span_id * 100 AS "start", 'state ' || span_id AS state FROM ({_SPANS}) s)
SELECT t.doc_id, t.span_id, h.state FROM t ASOF LEFT JOIN h ON t.doc_id = h.doc_id AND t."at" >= h."start" """)
def heading_asof(spark, sf):
    """Every span is a point and a state."""
    points = span_rows(spark, sf).select("doc_id", "span_id", "start")
    states = span_rows(spark, sf).select("doc_id", (F.col("span_id") * 100).cast("int").alias("start"), F.concat(F.lit("state "), F.col("span_id").cast("string")).alias("state"))
    return I.as_of(points, states, "state").select("doc_id", "span_id", "state")


@query(f"""SELECT s.doc_id, span_id, substr(text, greatest("start" - 200, 0) + 1, "start" - greatest("start" - 200, 0)) AS before, substr(text, "end" + 1, 200) AS after FROM ({_SPANS}) s JOIN documents d USING (doc_id)""")
def neighbor_text(spark, sf):
    blocks = span_rows(spark, sf)
    return R.neighbour_texts(table(spark, sf, "documents"), blocks, "medium").select("doc_id", "span_id", "before", "after")


@query(f"""WITH b AS (SELECT doc_id, span_id AS block_id, greatest("start" - 100, 0) AS s, "end" + 100 AS e FROM ({_SPANS}) x)
SELECT b.doc_id, b.block_id::INT AS block_id, count(x.doc_id)::BIGINT AS n FROM b LEFT JOIN ({_SPANS}) x ON x.doc_id = b.doc_id AND x."start" < b.e AND b.s < x."end" AND x."start" < x."end" GROUP BY ALL""")
def neighbor_extractions(spark, sf):
    """Every span of every document is a block."""
    spans = span_rows(spark, sf)
    blocks = spans.withColumn("block_id", F.col("span_id").cast("int"))
    near = spans.select("doc_id", "start", "end", F.lit("x").alias("class"), F.col("span_id").cast("string").alias("text"))
    return I.neighbours(blocks, near, 100).select("doc_id", "block_id", F.size("neighbours").cast("long").alias("n"))


#: The Markdown of markdown_rows, its lines, and its headings outside fences.
_HEADINGS = r"""md AS (SELECT doc_id, '# ' || coalesce(source, '') || chr(10) || chr(10) || '## Contents' || chr(10) || '- [a](#a)' || chr(10) || '- [b](#b)' || chr(10) || chr(10) ||
  array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE (i - 1) % 4 WHEN 0 THEN chr(10) || '## ' || substr(x, 1, 20) || chr(10) WHEN 1 THEN '- ' WHEN 2 THEN chr(10) ELSE '### sub' || chr(10) END || x || chr(10)), '')
  || '```' || chr(10) || 'code # not a heading' || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) AS text FROM documents),
ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM md) x),
pl AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS e, regexp_matches(line, '^\s*(```|~~~)') AS mark FROM ln),
fl AS (SELECT *, mark OR sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY k) % 2 = 1 AS fenced FROM pl),
h AS (SELECT doc_id, (e - length(line) - 1)::INT AS "start", e::INT AS "end", length(regexp_extract(trim(line), '^(#+)', 1)) AS level, regexp_replace(trim(line), '\s+$', '') AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n
  FROM fl WHERE NOT fenced AND regexp_matches(line, '^\s*#{1,6}\s+\S'))"""


@query(f"""WITH RECURSIVE {_HEADINGS}, t AS (SELECT doc_id, n, "start", [heading] AS tree FROM h WHERE n = 1 UNION ALL
  SELECT h.doc_id, h.n, h."start", list_append(t.tree[1:h.level - 1], h.heading) FROM t JOIN h ON h.doc_id = t.doc_id AND h.n = t.n + 1)
SELECT doc_id, "start", array_to_string(tree, ' > ') AS tree FROM t""")
def heading_trees(spark, sf):
    return I.heading_trees(I.heading_rows(I.marked_lines(markdown_rows(spark, sf)))).select("doc_id", "start", F.array_join("tree", " > ").alias("tree"))


@query(f"""WITH {_HEADINGS}, f AS (SELECT doc_id, min("start") AS s FROM h WHERE heading = '### sub' GROUP BY doc_id),
z AS (SELECT h.doc_id, min(h."start") AS stop FROM h JOIN f ON h.doc_id = f.doc_id WHERE h."start" > s AND level <= 3 GROUP BY h.doc_id),
w AS (SELECT *, lead("start") OVER (PARTITION BY doc_id ORDER BY "start") AS next FROM h)
SELECT w.doc_id, string_agg(CASE WHEN w."start" = s THEN substr(text, s + 1, coalesce(next, length(text)) - s) ELSE substr(text, w."start" + 1, w."end" - w."start") END, '' ORDER BY w."start") AS section
FROM w JOIN f ON f.doc_id = w.doc_id LEFT JOIN z ON z.doc_id = w.doc_id JOIN md ON md.doc_id = w.doc_id WHERE w."start" >= s AND (stop IS NULL OR w."start" < stop) GROUP BY w.doc_id""")
def section_content(spark, sf):
    docs = markdown_rows(spark, sf)
    headings = shared.written(I.heading_rows(I.marked_lines(docs)), "headings")  # several steps read them
    return I.section_text(docs, headings, "### sub")


@query()
def residual_blocks_clean(spark, sf):
    spans = span_rows(spark, sf).withColumn("class", F.lit("x"))
    return R.residual_blocks(markdown_rows(spark, sf), spans, fences=True).withColumn("tree", F.array_join("tree", " > "))


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, span_id, (span_id % 3)::INT AS pass, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY doc_id ORDER BY span_id % 3, span_id) AS n FROM ({_SPANS}) x WHERE "start" < "end"),
t AS (SELECT doc_id, n, [{{'span_id': span_id, 'pass': pass, 's': s, 'e': e}}] AS kept FROM o WHERE n = 1 UNION ALL
  SELECT o.doc_id, o.n, CASE WHEN o.pass > 0 AND len(list_filter(t.kept, lambda k: k.s < o.e AND o.s < k.e)) > 0 THEN t.kept ELSE list_append(t.kept, {{'span_id': o.span_id, 'pass': o.pass, 's': o.s, 'e': o.e}}) END
  FROM t JOIN o ON o.doc_id = t.doc_id AND o.n = t.n + 1),
a AS (SELECT doc_id, unnest(max_by(kept, n)) AS k FROM t GROUP BY doc_id)
SELECT doc_id, k.span_id AS span_id, k.pass AS pass, k.s AS "start", k.e AS "end" FROM a""")
def passes_merged(spark, sf):
    spans = span_rows(spark, sf).where("start < end").withColumn("pass", (F.col("span_id") % 3).cast("int")).withColumn("ord", F.col("span_id"))
    return I.kept_passes(spans).select("doc_id", "span_id", "pass", "start", "end")


# --- parsing, inference, alignment --------------------------------------------------------------------------------------

_OUTPUT = """'{"extractions":[{"' || event_type || '":"' || user_id || '","' || event_type || '_attributes":{"k":"' || event_id % 7 || '"}},{"count":' || event_id || '}]}'"""


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit('{"extractions":[{"'), F.col("event_type"), F.lit('":"'), e("user_id"), F.lit('","'), F.col("event_type"), F.lit('_attributes":{"k":"'), (F.col("event_id") % 7).cast("string"), F.lit('"}},{"count":'), e("event_id"), F.lit("}]}"))
    k = F.col("event_id") % 6
    output = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("<think>{no}</think>\n"), body)).when(k == 3, F.lit("{broken")).otherwise(body)
    return table(spark, sf, "events").select("event_id", output.alias("output"))


@query("SELECT CASE WHEN event_id % 6 = 3 THEN 'not JSON' ELSE 'ok' END AS result, count(*)::BIGINT AS n FROM events GROUP BY 1")
def parse_errors(spark, sf):
    return P.parse_outputs(_outputs(spark, sf)).groupBy(F.coalesce("parse_error", F.lit("ok")).alias("result")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, 0 AS group_index, 1 AS extraction_index, event_type AS class, user_id::VARCHAR AS text, (event_id % 7)::VARCHAR AS k FROM events WHERE event_id % 6 <> 3
UNION ALL SELECT event_id, 1, 2, 'count', event_id::VARCHAR, NULL FROM events WHERE event_id % 6 <> 3""")
def flatten_extractions(spark, sf):
    flat = P.flatten(P.parse_outputs(_outputs(spark, sf)), ["event_id"])
    return flat.select("event_id", "group_index", "extraction_index", "class", "text", F.try_element_at("attributes", F.lit("k")).alias("k"))


_TEMPLATE = N.Template("List the numbers.", (N.Example("Call 12 now.", (("number", "12", {}),)),))
_RULES = N.Rules((("number", r"\d{2,}", {}), ("title", r"[A-Z][a-z]+ of [a-z]+", {"kind": "of"})))


@query()
def prompts_rendered(spark, sf):
    return N.prompts(C.with_previous(C.sentence_chunk_rows(table(spark, sf, "documents"), 500), 50), _TEMPLATE).select("doc_id", "chunk", "prompt")


@query()
def extract_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = extraction.extract(docs, _TEMPLATE, _RULES, extraction.ExtractConfig(limit=500))
    return rows.select("doc_id", "chunk", "ord", "class", "text", "status", "start", "end")


@query()
def align_status(spark, sf):
    """The first words of each sentence chunk as they are, with plurals, cut short and unknown."""
    chunks = shared.written(C.sentence_chunk_rows(table(spark, sf, "documents"), 300), "chunks")  # both sides read them
    words = F.split(F.regexp_replace("chunk_text", r"\s+", " "), " ")
    texts = F.array(F.array_join(F.slice(words, 1, 3), " "), F.concat(F.array_join(F.slice(words, 4, 4), " "), F.lit(" zzzz")), F.array_join(F.transform(F.slice(words, 9, 3), lambda w: F.concat(w, F.lit("s"))), " "), F.lit("qqqq xxxx"))
    wanted = chunks.select("doc_id", "chunk", F.posexplode(texts).alias("ord", "text"))
    return align_rows(chunks, wanted).select("doc_id", "chunk", "ord", "status", "start", "end")


@query("SELECT count(DISTINCT event_type)::BIGINT AS asked, count(*)::BIGINT AS answered FROM events")
def inference_memo(spark, sf):
    asked = table(spark, sf, "events").select("event_id", F.concat(F.lit("Q: about "), "event_type", F.lit("\nA: ")).alias("prompt"))
    rows, news = N.infer(asked, _RULES)
    return news.agg(F.count("*").alias("asked")).crossJoin(rows.where("output IS NOT NULL").agg(F.count("*").alias("answered")))  # one row each


# --- signals, neighbours, buckets ---------------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_./:-]+')) AS t FROM benchmark), h AS (SELECT item_id, sha256(t) AS h, count(*) AS n FROM w GROUP BY item_id, t),
e AS (SELECT item_id, (('0x' || substr(h, 1, 8))::BIGINT % 256)::INT AS slot, sum(n * CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL HAVING sum(n * CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) <> 0)
SELECT item_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM e""")
def hash_embedding(spark, sf):
    return V.hash_embedding(table(spark, sf, "benchmark"), "item_id", "text").withColumn("value", F.round("value", 6))


_KNN = """WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS signal_id, e.label AS bucket_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, signal_id, bucket_id) AS rank FROM h QUALIFY rank <= 20)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    index = e.select(F.col("vec_id").alias("signal_id"), F.col("label").alias("bucket_id"), F.col("embedding").alias("vector"))
    return V.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), index, 20, "source_index")


@query(f"{_KNN} SELECT query_id, signal_id, bucket_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM k")
def knn_topk(spark, sf):
    return _hits(spark, sf).select("query_id", "signal_id", "bucket_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


_FUSED = f"""{_KNN}, b AS (SELECT query_id, signal_id, bucket_id, rank, similarity FROM k UNION ALL SELECT query_id, signal_id, bucket_id, 21 - rank, similarity FROM k WHERE rank <= 10),
f AS (SELECT query_id, signal_id, bucket_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS best_rank, max(similarity) AS c FROM b GROUP BY ALL)"""


def _two_indexes(spark: SparkSession, sf: str) -> DataFrame:
    hits = shared.written(_hits(spark, sf), "hits")  # both indexes, scores and routes read them
    return hits.unionByName(hits.where("rank <= 10").withColumn("rank", 21 - F.col("rank")).withColumn("index_name", F.lit("reason_index")))


@query(f"{_FUSED} SELECT query_id, signal_id, bucket_id, round(s, 6) AS similarity, best_rank::INT AS best_rank FROM f")
def rrf_fused(spark, sf):
    return V.fused(_two_indexes(spark, sf)).select("query_id", "signal_id", "bucket_id", F.round("similarity", 6).alias("similarity"), F.col("best_rank").cast("int").alias("best_rank"))


_SCORES = f"""{_FUSED}, w AS (SELECT *, CASE WHEN c >= 0.75 THEN (c - 0.75) / 0.25 WHEN c <= 0.45 THEN -((0.45 - c) / 0.45) ELSE 0.3 * (c - 0.45) / 0.3 END AS w FROM f),
z AS (SELECT query_id, bucket_id, ln(1 + sum(greatest(w, 0)) ** 2 / (sum(greatest(w, 0) ** 2) + 1e-9)) * sum(w) AS score, count(*)::BIGINT AS support, sum((c >= 0.75)::INT)::BIGINT AS high, sum((c <= 0.45)::INT)::BIGINT AS low FROM w GROUP BY ALL)"""
_COSINE = V.RouteConfig(similarity="cosine")


@query(f"{_SCORES} SELECT query_id, bucket_id, round(score, 5) + 0 AS score, support, high, low FROM z")
def bucket_scores(spark, sf):
    return V.bucket_scores(V.fused(_two_indexes(spark, sf)), _COSINE).select("query_id", "bucket_id", (F.round("score", 5) + 0).alias("score"), "support", "high", "low")


@query(f"""{_SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bucket_id) AS k FROM z)
SELECT query_id, CASE WHEN score >= 0.6 THEN bucket_id::VARCHAR ELSE 'bucket_' || query_id END AS bucket_id, score < 0.6 AS created, CASE WHEN score >= 0.6 THEN 'matched_existing_bucket' ELSE 'created_new_bucket' END AS route_reason FROM t WHERE k = 1""")
def routes(spark, sf):
    scores = V.bucket_scores(V.fused(_two_indexes(spark, sf)), _COSINE)
    return V.routes(scores.select("query_id"), scores, _COSINE).drop("score")


@query(f"""SELECT signal_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(conclusion, (ts, event_id)) AS conclusion FROM ({_SIGNALS}) s WHERE conclusion <> 'noise' GROUP BY signal_id""")
def signals_latest(spark, sf):
    return V.latest(V.proposing(signal_rows(spark, sf)), "signal_id", F.struct("ts", "event_id")).select("signal_id", "event_id", "conclusion")


_SUPPORT = f"SELECT bucket_id, count(DISTINCT signal_id)::BIGINT AS signals, count(DISTINCT doc_ref)::BIGINT AS docs FROM ({_SIGNALS}) s GROUP BY bucket_id"


@query(_SUPPORT)
def bucket_support(spark, sf):
    return V.support(signal_rows(spark, sf))


@query(f"SELECT bucket_id, signals, docs, 'stable' AS status FROM ({_SUPPORT}) b WHERE docs >= 2 AND signals >= 5 AND bucket_id % 3 <> 0")
def bucket_eligible(spark, sf):
    status = F.when(F.col("bucket_id") % 3 == 0, "archived").when(F.col("bucket_id") % 3 == 1, "incubating").otherwise("stable")
    return V.eligible(V.support(signal_rows(spark, sf)).withColumn("status", status))


@query("""SELECT 'sig_' || substr(sha1(event_type || ':' || event_id || ':' || CASE event_id % 3 WHEN 0 THEN 'new_schema' ELSE 'new_attr' END), 1, 16) AS signal_id, event_id::INT AS block_id, 'h' || chr(10) || event_type AS source_embedding_text FROM events WHERE event_id % 3 < 2""")
def signals_built(spark, sf):
    found = V.proposing(signal_rows(spark, sf)).select("doc_ref", F.col("event_id").cast("int").alias("block_id"), "conclusion", F.lit("why").alias("reason"))
    blocks = table(spark, sf, "events").select(F.col("event_type").alias("doc_ref"), F.col("event_id").cast("int").alias("block_id"), F.col("event_type").alias("text"), F.array(F.lit("h")).alias("tree"))
    return V.build_signals(found, blocks).select("signal_id", "block_id", "source_embedding_text")


@query("SELECT page_id, regexp_full_match(url, 'https?://([A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*|localhost)(:\\d{1,5})?(/\\S*)?(\\?\\S*)?(#\\S*)?') AS is_url FROM pages")
def page_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"))


# --- files ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS document_id, length(coalesce(text, ''))::INT AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def csv_documents(spark, sf):
    """The documents as a delimited file and back."""
    path = shared.new_path(spark, "documents") + ".csv"
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # the writer trims by default
    rows.write.options(header=True, sep=";", quoteAll=True, escape='"', **kept).csv(path)
    text = F.coalesce("text", F.lit(""))
    return scans.csv_documents(spark, path, id_key="doc_id", text_key="text", delimiter=";").select("document_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    gold = gold_rows(spark, sf).withColumn("ord", F.col("idx")).withColumn("status", F.lit("match_exact"))
    docs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("text").alias("text"))
    return extraction.annotated(docs, gold)


@query(f"""SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS ord, class, text, kind FROM ({_GOLD}) g""")
def annotated_files(spark, sf):
    """Annotated documents written as JSON lines, read and exploded."""
    path = shared.new_path(spark, "annotated")
    sinks.write_annotated(_annotated(spark, sf).withColumn("token_interval", F.lit(None).cast("string")), path)
    rows = scans.exploded(scans.annotated_documents(spark, path))
    return rows.select("doc_id", "ord", "class", "text", F.try_element_at("attributes", F.lit("definition_type")).alias("kind"))


@query(f"SELECT doc_id::VARCHAR AS document_id, min(text) AS text, count(*)::INT AS n FROM ({_GOLD}) g GROUP BY doc_id")
def annotated_in_order(spark, sf):
    return _annotated(spark, sf).select("document_id", "text", F.size("extractions").alias("n"))


@query(f"SELECT bucket_id, conclusion, count(*)::BIGINT AS n FROM ({_SIGNALS}) s GROUP BY ALL")
def json_stores(spark, sf):
    """Signals appended to a store in two parts and read again."""
    path, rows = shared.new_path(spark, "store"), signal_rows(spark, sf).select("event_id", "bucket_id", "conclusion")
    sinks.append_json(rows.where("event_id % 2 = 0"), path)
    sinks.append_json(rows.where("event_id % 2 <> 0"), path)
    return scans.json_store(spark, path, "bucket_id long, conclusion string").groupBy("bucket_id", "conclusion").agg(F.count("*").alias("n"))


@query(f"""SELECT s.doc_id::VARCHAR AS doc_ref, span_id::INT AS block_id, "start", "end", substr(text, "start" + 1, "end" - "start") AS text, 'a > b' AS tree FROM ({_SPANS}) s JOIN documents d USING (doc_id) WHERE "start" < "end" """)
def residual_files(spark, sf):
    """Blocks of each document as one JSON line, written and read again."""
    path = shared.new_path(spark, "residual")
    spans = span_rows(spark, sf).where("start < end").join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")
    blocks = spans.select("doc_id", F.col("span_id").cast("int").alias("block_id"), "start", "end", T.span(F.col("whole"), F.col("start"), F.col("end")).alias("text"), F.array(F.lit("a"), F.lit("b")).alias("tree"))
    R.document_json(blocks).select("json").write.text(path)
    return scans.residual_documents(spark, path, lines=True).select("doc_ref", "block_id", "start", "end", "text", F.array_join("tree", " > ").alias("tree"))


@query("SELECT event_type AS run_id, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type")
def observer_files(spark, sf):
    """Records of runs written by run and read again; a table without records isn't written."""
    path = shared.new_path(spark, "observer")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("run_id"))
    sinks.write_observer({"chunks": rows, "prompts": rows.where("false")}, path)
    return scans.observed(spark, path, "chunks", "event_id long").groupBy("run_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, class, text FROM ({_PRED}) p")
def prediction_files(spark, sf):
    """Prediction documents as JSON lines, read and exploded."""
    path = shared.new_path(spark, "predictions") + ".jsonl"
    item = F.struct(F.col("class").alias("extraction_class"), F.col("text").alias("extraction_text"))
    pred_rows(spark, sf).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_list(item).alias("items")).write.json(path)
    rows = scans.prediction_documents(spark, path).select("doc_id", F.explode("extractions").alias("e"))
    return rows.select("doc_id", F.col("e.extraction_class").alias("class"), F.col("e.extraction_text").alias("text"))


# --- more text functions and checks ---------------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{M}]+'))) AS t FROM benchmark)
SELECT item_id, CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN substr(t, 1, length(t) - 1) ELSE t END AS stem, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def token_stems(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(T.lower_tokens(F.col("text"))).alias("t")).where(T.token_kind(F.col("t")) == T.WORD)
    return rows.groupBy("item_id", T.stem(F.col("t")).alias("stem")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_HEADINGS}, b AS (SELECT doc_id, line, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS s FROM ln),
c AS (SELECT *, regexp_replace(regexp_replace(s, '^[\s\[\]()<>{{}}''"`*_#.,;:!?-]+', ''), '[\s\[\]()<>{{}}''"`*_#.,;:!?-]+$', '') AS core FROM b)
SELECT doc_id, sum((s = '' OR regexp_full_match(s, '[\s\-\[\]()#>*_`~|:;,.!?/\\]+'))::INT)::BIGINT AS empty, sum(regexp_full_match(core, '(https?://\S+|www\.\S+)')::INT)::BIGINT AS url,
  sum((len(regexp_extract_all(line, '\[[^\]]+\]\(#.+?\)')) >= 2)::INT)::BIGINT AS toc, sum(regexp_full_match(line, '\s*#{{1,6}}\s+[^\n]+')::INT)::BIGINT AS heading FROM c GROUP BY doc_id""")
def text_tests(spark, sf):
    """How many lines of each Markdown document are empty, an address, a table of contents or a lone heading."""
    rows = markdown_rows(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    x, n = F.col("line"), lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.groupBy("doc_id").agg(n(T.is_empty_text(x)).alias("empty"), n(T.is_url_text(x)).alias("url"), n(T.is_toc_text(x)).alias("toc"), n(T.is_heading_text(x)).alias("heading"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 117)) || '...' END AS preview FROM f""")
def previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(f"""SELECT doc_id, span_id, greatest(0, "end" - "start") AS n FROM ({_SPANS}) s""")
def span_lengths(spark, sf):
    return span_rows(spark, sf).select("doc_id", "span_id", T.span_length(F.col("start"), F.col("end")).alias("n"))


@query(f"""SELECT doc_id, idx, kind IS NULL OR turn % 4 <> 1 AS forth, kind IS NOT NULL AND turn % 4 <> 1 AND turn % 4 <> 2 OR kind IS NULL AND turn % 4 <> 2 AS back FROM ({_GOLD}) g""")
def attribute_matches(spark, sf):
    """Attributes that differ by case and spaces, by value, or by a key on one side."""
    t, kind = F.col("turn"), F.col("kind")
    own = F.when(kind.isNotNull(), F.create_map(F.lit("definition_type"), kind)).otherwise(F.create_map().cast("map<string,string>"))
    other = F.when(kind.isNotNull(), F.create_map(F.lit("definition_type"), F.when(t % 4 == 1, F.lit("unlike")).otherwise(F.concat(F.lit("  "), F.upper(kind))))).otherwise(F.create_map().cast("map<string,string>"))
    other = F.when(t % 4 == 2, F.map_concat(other, F.create_map(F.lit("more"), F.lit("x")))).otherwise(other)
    rows = gold_rows(spark, sf).select("doc_id", "idx", T.normal_attributes(own).alias("a"), T.normal_attributes(other).alias("b"))
    return rows.select("doc_id", "idx", T.normal_attributes_within(F.col("a"), F.col("b")).alias("forth"), T.normal_attributes_within(F.col("b"), F.col("a")).alias("back"))


@query(f"SELECT doc_id, idx, CASE turn % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b' WHEN 2 THEN 'b' ELSE 'b' END AS shown FROM ({_GOLD}) g")
def shown_attributes(spark, sf):
    t = F.col("turn")
    value = F.when(t % 4 == 0, "x").when(t % 4 == 1, "").when(t % 4 == 2, "null")
    rows = gold_rows(spark, sf).select("doc_id", "idx", T.shown_attributes(F.create_map(F.lit("a"), value, F.lit("b"), F.lit("y"))).alias("m"))
    return rows.select("doc_id", "idx", F.array_join(F.map_keys("m"), ",").alias("shown"))


@query(f"SELECT class, CASE WHEN kind IS NOT NULL THEN 'definition_type' END AS attribute, false AS is_list FROM ({_GOLD}) g GROUP BY ALL")
def response_schema(spark, sf):
    return P.response_schema(gold_rows(spark, sf))


@query("""WITH d AS (SELECT event_id // 2 AS doc_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS domain FROM events)
SELECT doc_id, 'duplicate_doc_id' AS problem FROM d GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'missing_domain' FROM d WHERE domain IS NULL""")
def dataset_problems(spark, sf):
    e = F.col("event_id")
    return E.dataset_problems(table(spark, sf, "events").select(F.floor(e / 2).alias("doc_id"), F.when(e % 7 != 0, F.col("event_type")).alias("domain")))


@query(f"""SELECT doc_id, count(*) FILTER (WHERE class = 'tale' OR (kind IS NOT NULL AND class <> 'definition') OR (class = 'definition' AND kind = 'unheard'))::BIGINT AS numerator, count(*)::BIGINT AS denominator FROM ({_PRED}) p GROUP BY doc_id""")
def anomaly_rates(spark, sf):
    return E.anomaly_rate(pred_rows(spark, sf), ("doc_id",)).select("doc_id", "numerator", "denominator")


@query(f"""WITH a AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM ({_PRED}) p WHERE class = 'tale' OR (kind IS NOT NULL AND class <> 'definition') OR (class = 'definition' AND kind = 'unheard'))
SELECT doc_id, idx FROM a WHERE k <= 20""")
def anomaly_samples(spark, sf):
    return E.anomaly_samples(pred_rows(spark, sf)).select("doc_id", "idx")


@query(f"SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT class)::BIGINT AS classes, count(DISTINCT turn // 3)::BIGINT AS chunks FROM ({_GOLD}) g GROUP BY doc_id")
def extraction_summary(spark, sf):
    return extraction.summary(gold_rows(spark, sf).withColumn("chunk", F.floor(F.col("turn") / 3)))


def _span_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = span_rows(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("span_id").alias("chunk"), T.span(F.col("text"), F.col("start"), F.col("end")).alias("chunk_text"))


@query(f"""WITH c AS (SELECT s.doc_id, span_id, substr(text, "start" + 1, "end" - "start") AS t FROM ({_SPANS}) s JOIN documents d USING (doc_id)), p AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY span_id) AS b FROM c)
SELECT doc_id, span_id AS chunk, substr(b, greatest(length(b) - 29, 1), 30) AS previous FROM p""")
def previous_text(spark, sf):
    """The last 30 characters of the piece before each."""
    return C.with_previous(_span_chunks(spark, sf), 30).select("doc_id", "chunk", "previous")


@query(f"SELECT doc_id, span_id AS chunk, ((row_number() OVER (ORDER BY doc_id, span_id) - 1) // 10)::INT AS batch FROM ({_SPANS}) s")
def batches_in_order(spark, sf):
    return C.batches(_span_chunks(spark, sf), 10).select("doc_id", "chunk", "batch")


@query(f"SELECT ord, doc_id, block_id FROM (SELECT doc_id, span_id::INT AS block_id FROM ({_SPANS}) s) b JOIN (VALUES (0, 4), (1, 0), (2, 5)) w(ord, block_id) USING (block_id)")
def blocks_by_id(spark, sf):
    return R.blocks_by_id(span_rows(spark, sf).select("doc_id", F.col("span_id").cast("int").alias("block_id")), [4, 0, 5]).select("ord", "doc_id", "block_id")
