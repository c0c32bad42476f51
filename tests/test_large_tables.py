"""What failed on larger tables or on odd inputs there."""

import difflib
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.operators import align as A
from spanloom.operators import chunks as C
from spanloom.functions import text as T
from spanloom.operators import evaluate as E
from spanloom.operators import evolve as V
from spanloom.operators import intervals as I
from spanloom.operators import tokens as K


def test_csv_documents_keep_outer_white_space(spark, tmp_path):
    texts = [" lead", "trail ", "\t\ttab\t", "\r", "\r\na", "x\n", "\n", " ", "\0", 'a";"b\n', "a\rb\r\n", "", None]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["document_id"], r["n_chars"], r["digest"]) for r in catalog.QUERIES["csv_documents"](spark, str(tmp_path)).collect()}
    assert got == {(str(k), len(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for k, t in enumerate(texts)}


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_makes_neither_side_twice(spark):
    chunks = spark.createDataFrame([(1, 0, "Alpha beta gamma.", 5, 40)], "doc_id long, chunk int, chunk_text string, first_token int, start int")
    asked = spark.createDataFrame([(1, 0, 1, "gammas", {"k": "v"}), (1, 0, 0, "Alpha beta", None), (1, 0, 2, None, None), (9, 0, 0, "x", None)], "doc_id long, chunk int, ord int, text string, attributes map<string,string>")
    asked = asked.mapInArrow(lambda batches: batches, asked.schema)
    rows = A.align_rows(chunks, asked)
    assert rows.columns == ["doc_id", "chunk", "ord", "text", "attributes", "status", "first_token", "end_token", "start", "end"]
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 0, "Alpha beta", None, "match_exact", 5, 7, 40, 50), (1, 0, 1, "gammas", {"k": "v"}, "match_fuzzy", 7, 8, 51, 56), (1, 0, 2, None, None, None, None, None, None, None)]
    assert _plan(rows).count("MapIn") == 2  # the extractions and the alignment


def test_best_window_of_a_long_text_takes_few_comparisons(monkeypatch):
    calls, blocks = [], A.matching_blocks
    monkeypatch.setattr(A, "matching_blocks", lambda a, b: calls.append(1) or blocks(a, b))
    source = ["x", "b", *(f"w{k}" for k in range(3000)), "a", "y"]
    assert A._best_window(source, ["a", "b"], 0.5) == (0, 2)
    assert len(calls) <= 3


def test_matching_blocks_are_those_of_the_standard_library():
    draw = random.Random(3)
    for _ in range(500):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(20))] for _ in range(2))
        assert A.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(autojunk=False, a=a, b=b).get_matching_blocks()[:-1]]


def test_nearest_pairs_no_rows_and_agrees_with_the_fold(spark):
    draw, x = np.random.default_rng(7), []
    for k in range(150):
        x.append(draw.integers(-2, 3, size=6).astype(float).tolist() if k % 2 else draw.normal(size=6).tolist())
    x[3], x[20], x[21], x[40], x[41], x[42], x[43] = None, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan, *[1.0] * 5], [math.inf, *[1.0] * 5], [1e-170] * 6, [1e160] * 6
    x[44], x[45], x[46] = [1.0, 2.0], [], x[20]
    index = spark.createDataFrame([(f"s{k % 140}", None if k % 9 == 0 else k % 3, v) for k, v in enumerate(x)], "signal_id string, bucket_id int, vector array<double>")
    queries = spark.createDataFrame([(k, x[k]) for k in (1, 3, 20, 21, 40, 41, 42, 43, 44, 45, 100)], "query_id long, vector array<double>")
    pairs = index.crossJoin(queries.select("query_id", F.col("vector").alias("_q"))).select("query_id", "signal_id", "bucket_id", V.cosine(F.col("vector"), F.col("_q")).alias("similarity"))
    wanted = sorted(map(str, V._top(pairs, ["query_id"], 5).select("query_id", "signal_id", "bucket_id", "similarity", "_rank").collect()))
    for blocks in ((100, 1000), (4, 13)):
        got = V.nearest(queries, index, 5, query_block=blocks[0], index_block=blocks[1])
        assert "Join" not in _plan(got)
        assert sorted(map(str, got.drop("index_name").withColumnRenamed("rank", "_rank").collect())) == wanted


def test_best_in_small_blocks():
    draw = np.random.default_rng(8)
    e = draw.integers(-1, 2, size=(90, 4)).astype(float)
    pack = lambda v: (v, np.full(len(v), 4))
    whole = V._best(pack(e[:20]), pack(e), np.arange(90), 7)
    parts = V._best(pack(e[:20]), pack(e), np.arange(90), 7, step=3, width=11)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(whole[0]) == 140


def test_documents_give_small_frames(spark):
    class Docs:
        schema = spark.createDataFrame([], "doc_id long, text string").schema
        select = lambda self, *_: self
        withColumnRenamed = lambda self, *_: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(["# A heading\n\nSome words here.\n" * 10_000] * 19 + [None])], names=["id", "text"])
    for make in (C.sentence_chunk_rows, C.block_rows, C.container_rows, C.structured_chunk_rows):
        frames = list(make(Docs()).run(iter([batch])))
        assert max(f.num_rows for f in frames) <= C.FRAME_ROWS and max(f.nbytes for f in frames) < 4 * C.FRAME_CHARACTERS
        assert set(pa.Table.from_batches(frames)["id"].to_pylist()) == set(range(19))


def test_batches_make_chunks_once(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "doc_id long, text string")
    assert "MapIn" not in _plan(C.batches(C.sentence_chunk_rows(docs, 5), 2))


def test_tokens_are_cut_without_a_shuffle(spark):
    draw = random.Random(4)
    odd = ["a", "B", "é", "7", "٣", ".", "?", "!", "。", '"', "'", ")", "”", "\n", "\r\n", " ", "\x85", "_", "--", "²", "ⅷ", "Mr", "Dr.", "\u0301", "\u200d", "漢", "😀", "ß", "\x1c"]
    texts = ["".join(draw.choice(odd) for _ in range(draw.randrange(40))) for _ in range(300)] + ["", None, "\n", "a."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    rows = K.token_rows(docs, sentences=True)
    assert "Window" not in _plan(rows) and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    cut = docs.select("doc_id", F.posexplode(T.pieces(F.col("text"))).alias("place", "token")).withColumn("space", T.is_space(F.col("token"))).orderBy("doc_id", "place").collect()
    wanted, held = [], {}
    for r in cut:  # by the pieces of the JVM
        doc = held.setdefault(r["doc_id"], {"at": 0, "idx": 0, "gap": ""})
        a, doc["at"] = doc["at"], doc["at"] + len(r["token"])
        if r["space"]:
            doc["gap"] = r["token"]
            continue
        wanted.append((r["doc_id"], doc["idx"], r["token"], a, doc["at"], doc["idx"] > 0 and bool(set(doc["gap"]) & set("\r\n"))))
        doc["idx"], doc["gap"] = doc["idx"] + 1, ""
    got = rows.orderBy("doc_id", "idx").collect()
    assert [tuple(r[c] for c in ("doc_id", "idx", "token", "start", "end", "nl")) for r in got] == wanted
    kinds = rows.select("kind", T.token_kind(F.col("token")).alias("k"))
    assert kinds.where("kind <> k").count() == 0
    assert sorted(map(tuple, K.sentence_rows(rows.drop("sentence")).collect())) == sorted(map(tuple, got))


def test_spans_meet_tokens_within_their_text(spark):
    draw = random.Random(5)
    texts = ["ab cd. " * draw.randrange(30) for _ in range(40)] + ["word " * 450_000] * 2 + ["x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spans = [(d, k, a := draw.randrange(60), a + draw.randrange(-3, 20)) for d in range(43) for k in range(4)] + [(41, 9, 2_000_001, 2_000_012), (42, 9, -5, 2_147_483_647), (42, 10, None, 3), (77, 0, 0, 5)]
    spans = spark.createDataFrame(spans, "doc_id long, span_id long, start int, end int")
    rows = K.spans_to_text_tokens(spans, docs)
    assert "Generate" not in _plan(rows)
    wanted = spans.join(K.token_rows(docs).select("doc_id", "idx", F.col("start").alias("s"), F.col("end").alias("e")), "doc_id").where("s < end AND start < e").groupBy("doc_id", "span_id", "start", "end").agg(F.min("idx"), F.max("idx") + 1)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, wanted.collect()))


def test_marked_lines_need_no_shuffle(spark):
    draw = random.Random(6)
    parts = ["a b", "```", "~~~", "  ```py", "# H", "## H  two", " ### three", "", "x|y|z", "- i", "\x0bq"]
    texts = ["".join(draw.choice(parts) + draw.choice(["\n", "\r\n", "\r", " "]) for _ in range(draw.randrange(25))) for _ in range(200)] + ["", None, "```", "# end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    rows, plain = I.marked_lines(docs), I.fence_lines(I.line_rows(docs))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    names = ["doc_id", "line_no", "line", "start", "end", "kind", "fenced"]
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))
    wanted = {}
    for r in I.heading_rows(plain).orderBy("doc_id", "start").collect():
        above = wanted.setdefault(r["doc_id"], [])
        above.append((r["start"], [*(above[-1][1] if above else [])[: r["level"] - 1], r["heading"]]))
    trees = I.heading_trees(I.heading_rows(rows))
    assert "aggregate" not in _plan(trees).replace("Aggregate", "")
    got = {}
    for r in trees.orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["tree"]))
    assert got == wanted


def test_evaluation_sends_each_text_to_python_once(spark):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(4)]
    rows = [(d, k, draw.choice(["goal", "risk", None]), " ".join(draw.choice(words) for _ in range(draw.randrange(7))), draw.choice([None, {"k": "x"}, {"k": "y"}])) for d in (1, 2, None) for k in range(40)]
    make = lambda rows: E.normalised(spark.createDataFrame(rows, "doc_id long, idx int, class string, text string, attributes map<string,string>"), False)
    pred, gold = make([r for r in rows if r[1] % 3]), make([(d, k, c, t + " w0" * (k % 2), a) for d, k, c, t, a in rows])
    for relaxed in (True, False):
        pairs = E.legal_pairs(pred, gold, relaxed=relaxed)
        plan = _plan(pairs)
        assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1
        side = lambda x, s: x.where("doc_id IS NOT NULL").select("doc_id", *(F.col(c).alias(f"{s}_{c}") for c in ("idx", "class", "norm", "norm_attributes")))
        every = side(pred, "p").join(side(gold, "g"), "doc_id")
        weight = T.relaxed_match(F.col("g_norm"), F.col("p_norm"), *(E.THRESHOLDS[k] for k in ("text_relaxed_f1", "substring_precision", "substring_recall", "lccs_ratio"))) if relaxed else F.when(F.expr("p_norm = g_norm"), 1.0)
        fit = T.normal_attributes_within(F.col("p_norm_attributes"), F.col("g_norm_attributes"))
        wanted = every.select("doc_id", "p_idx", "g_idx", F.col("g_class").alias("class"), F.expr("p_class = g_class").alias("same"), fit.alias("fit"), weight.alias("weight")).where("weight IS NOT NULL")
        got = sorted(map(repr, (tuple(r) for r in pairs.collect())))
        assert got == sorted(map(repr, (tuple(r) for r in wanted.collect()))) and len(got) > 50
    assert _plan(E.matched_edges(pred, gold)).count("MapInArrow") == 1


def test_documents_go_on_across_batches():
    rows = [(d, k % 2 == 0, k, "goal", f"t{k}", []) for d, n in ((1, 5), (2, 1), (3, 2500), (4, 2)) for k in range(n)]
    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())))]
    table = pa.RecordBatch.from_arrays(columns, names=["doc_id", "is_pred", "idx", "class", "norm", "norm_attributes"])
    batches = [table.slice(a, b - a) for a, b in ((0, 3), (3, 6), (6, 6), (6, 1300), (1300, len(rows)))]
    assert [(d, len(p), len(g)) for d, p, g in E._documents(iter(batches))] == [(1, 3, 2), (3, 1250, 1250), (4, 1, 1)]


def test_a_long_document_verifies_few_pairs(monkeypatch):
    draw, calls, weigh = random.Random(5), [], T.relaxed_weight
    monkeypatch.setattr(T, "relaxed_weight", lambda *a: calls.append(1) or weigh(*a))
    # the longest words are in every text, so an order by length lets all pairs meet
    texts = [" ".join(["everywhere", "commonplace", "ubiquitous", *(f"w{draw.randrange(4000)}" for _ in range(9))]) for _ in range(300)]
    found = list(E._text_pairs([t + " x" for t in texts], texts, E.THRESHOLDS))
    assert len(found) == 300 and all(x == y + " x" for x, y, _ in found) and len(calls) < 5000


def test_bags_are_counted_without_comparing_all_tokens(spark):
    draw = random.Random(2)
    rows = [([draw.choice(["a", "b", "c", "é", "", None]) for _ in range(draw.randrange(9))], [draw.choice(["a", "b", "c", "d", "", None]) for _ in range(draw.randrange(9))]) for _ in range(2500)]
    rows += [(None, ["a"]), (["a"], None), ([], []), (["a"] * 20000, ["a"] * 30000 + [str(k) for k in range(30000)])]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    bag = lambda x: Counter(t for t in x if t is not None)
    got = {r["k"]: r["n"] for r in frame.select("k", T.bag_overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {k: None if a is None or b is None else (bag(a) & bag(b)).total() for k, (a, b) in enumerate(rows)}
    frame = spark.createDataFrame([(1, 0, "a b")], "doc_id int, idx int, text string")
    plan = _plan(catalog._token_overlaps(frame, F.lower("text")))
    assert plan.count("regexp_extract_all") == 2 and "lambdafunction" not in plan
