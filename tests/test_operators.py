import difflib
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.operators import align as A
from spanloom.operators import evaluate as E
from spanloom.operators import evolve as V
from spanloom.operators import inference as N
from spanloom.operators import intervals as I
from spanloom.operators import residual as R
from spanloom.operators.tokens import scan
from spanloom.plans import evaluation, evolution, extraction

ROWS = "doc_id long, idx int, class string, text string, attributes map<string,string>, alignment_status string"


# --- intervals ---


def test_interval_algebra_against_sets(spark):
    draw = np.random.default_rng(1)
    docs = spark.createDataFrame([(d, "x" * int(draw.integers(0, 80))) for d in range(30)], "doc_id int, text string")
    size = {r["doc_id"]: len(r["text"]) for r in docs.collect()}
    spans = [(int(draw.integers(0, 30)), int(a), int(a + draw.integers(-3, 20))) for a in draw.integers(-5, 80, 120)] + [(0, None, 4)]
    merged = I.merged(I.clamp(spark.createDataFrame(spans, "doc_id int, start int, end int"), docs))
    gaps = I.complement(merged, docs)
    for d in range(30):
        covered = {k for i, a, b in spans if i == d and a is not None for k in range(max(a, 0), min(b, size[d]))}
        own, left = ([(r["start"], r["end"]) for r in x.where(F.col("doc_id") == d).orderBy("start").collect()] for x in (merged, gaps))
        assert {k for a, b in own for k in range(a, b)} == covered and {k for a, b in left for k in range(a, b)} == set(range(size[d])) - covered
        assert all(p[1] < q[0] for p, q in itertools.pairwise(own)) if d % 10 == 0 else True
        if d >= 5:
            break


def test_overlaps_once_in_small_cells(spark):
    draw = np.random.default_rng(2)
    spans = [(k, int(a), int(a + n)) for k, (a, n) in enumerate(zip(draw.integers(0, 200, 40), draw.integers(1, 60, 40), strict=True))]
    left = spark.createDataFrame([(1, *s) for s in spans], "doc_id int, k int, start int, end int")
    right = left.select("doc_id", F.col("k").alias("m"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    found = sorted((r["k"], r["m"]) for r in I.overlaps(left, right, cell=16).collect())
    assert found == sorted((p[0], q[0]) for p in spans for q in spans if p[1] < q[2] and q[1] < p[2])


def test_passes(spark):
    rows = [(1, 0, 0, 0, 10), (1, 0, 1, 5, 12), (1, 1, 0, 11, 20), (1, 1, 1, 20, 30), (1, 1, 2, 25, 40), (1, 1, 3, None, None), (1, 2, 0, 12, 20), (1, 2, 1, 30, 31)]
    kept = I.kept_passes(spark.createDataFrame(rows, "doc_id int, pass int, ord int, start int, end int")).collect()
    assert sorted((r["pass"], r["ord"]) for r in kept) == [(0, 0), (0, 1), (1, 1), (1, 3), (2, 0), (2, 1)]


MARKDOWN = "<!-- toc -->\n- [a](#a)\n<!-- /toc -->\n# Top\nintro text here\n## Sub\n```\n# not\n```\nbody of sub\n### Deep\ndeep body\n## Other\nhttps://only.url\n"


def test_headings_fences_sections(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None)], "doc_id int, text string")
    fenced = I.fence_lines(I.line_rows(docs))
    heads = I.heading_rows(fenced)
    assert [(r["level"], r["heading"]) for r in heads.orderBy("start").collect()] == [(1, "# Top"), (2, "## Sub"), (3, "### Deep"), (2, "## Other")]
    assert [r["tree"] for r in I.heading_trees(heads).orderBy("start").collect()][2] == ["# Top", "## Sub", "### Deep"]
    assert I.toc_spans(docs).select("start", "end").collect()[0] == (0, MARKDOWN.index("# Top") - 1)
    fence = I.fence_spans(fenced).first()
    assert MARKDOWN[fence["start"] : fence["end"]] == "```\n# not\n```\n"
    assert I.section_text(docs, heads, "## Sub").first()["section"] == "## Sub\n```\n# not\n```\nbody of sub\n### Deep\n"
    points = spark.createDataFrame([(1, 3), (1, MARKDOWN.index("deep body"))], "doc_id int, start int")
    trees = {r["start"]: r["tree"] for r in I.as_of(points, I.heading_trees(heads), "tree").collect()}
    assert trees[3] is None and trees[MARKDOWN.index("deep body")][-1] == "### Deep"
    holes = spark.createDataFrame([(1, 0, 5)], "doc_id int, start int, end int")
    assert I.slice_without(docs, holes, F.lit(2), F.lit(9)).where("doc_id = 1").first()["left"] == MARKDOWN[5:9]


def test_residual_blocks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id int, text string")
    at = MARKDOWN.index("intro")
    found = R.residual_blocks(docs, spark.createDataFrame([(1, "c", at, at + 6), (1, "no", 0, 5)], "doc_id int, class string, start int, end int"), ignore=("no",), fences=True).orderBy("block_id").collect()
    assert [(r["text"], r["tree"]) for r in found] == [("text here", ["# Top"]), ("body of sub", ["# Top", "## Sub"]), ("deep body", ["# Top", "## Sub", "### Deep"])]
    assert all(MARKDOWN[r["start"] : r["end"]] == r["text"] for r in found)
    raw = spark.createDataFrame([(1, 0, 12, "## H\n body  ", ["a"]), (1, 20, 25, " ... ", []), (1, 30, 36, "## H2\n", [])], "doc_id int, start int, end int, text string, tree array<string>")
    clean = R.clean_blocks(raw).collect()
    assert [(r["text"], r["start"], r["end"], r["tree"], r["block_id"]) for r in clean] == [("body", 6, 10, ["a", "## H"], 0)]
    assert json.loads(R.document_json(clean_to(spark, clean)).first()["json"])["resblocks"][0]["heading_tree"] == ["a", "## H"]
    with pytest.raises(Exception, match="no such block"):
        R.blocks_by_id(clean_to(spark, clean), [0, 9]).collect()


def clean_to(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["block_id"], r["start"], r["end"], r["text"], r["tree"]) for r in rows], "doc_id int, block_id int, start int, end int, text string, tree array<string>")


# --- alignment ---


def plain_best_window(source, wanted, threshold):
    best, found = 0.0, None
    matcher = difflib.SequenceMatcher(autojunk=False, b=wanted)
    for size in range(len(wanted), len(source) + 1):
        for at in range(len(source) - size + 1):
            matcher.set_seq1(source[at : at + size])
            score = sum(b.size for b in matcher.get_matching_blocks()) / len(wanted)
            if score > best:
                best, found = score, (at, at + size)
    return found if best >= threshold else None


def test_fuzzy_window_against_all_windows():
    draw = np.random.default_rng(3)
    for _ in range(150):
        source, wanted = [str(x) for x in draw.integers(0, 6, draw.integers(1, 16))], [str(x) for x in draw.integers(0, 7, draw.integers(1, 6))]
        assert A._best_window(source, wanted, 0.75) == plain_best_window(source, wanted, 0.75)


def test_alignment_statuses(spark):
    text = "The quick brown foxes jump over the lazy dogs near the river bank."
    found = A.align(text, ["quick brown", "brown foxes jump under", "lazy dog", "unseen words", ""], A.AlignConfig())
    # the alignment is one sequence, so the second extraction takes the word that the first one needs
    assert found[0][0] == A.LESSER and text[found[1][3] : found[1][4]] == "brown foxes jump"
    assert A.align(text, ["quick brown"], A.AlignConfig())[0][:3] == (A.EXACT, 1, 3)
    assert [f[0] for f in found][3:] == [None, None]
    fuzzy = A.align(text, ["lazy dog"], A.AlignConfig(accept_lesser=False))[0]
    assert fuzzy[0] == A.FUZZY and text[fuzzy[3] : fuzzy[4]] == "lazy dogs"
    assert A.align(text, ["lazy dog"], A.AlignConfig())[0][0] == A.LESSER
    assert A.align("", ["x"], A.AlignConfig()) == [(None,) * 5]
    with pytest.raises(ValueError, match="delimiter"):
        A.align(text, ["a ␟ b"], A.AlignConfig())
    chunks = spark.createDataFrame([(1, 0, text, 10, 100)], "doc_id int, chunk int, chunk_text string, first_token int, start int")
    wanted = spark.createDataFrame([(1, 0, 0, "quick brown"), (1, 0, 1, "zzz")], "doc_id int, chunk int, ord int, text string")
    rows = {r["ord"]: r for r in A.align_rows(chunks, wanted).collect()}
    assert (rows[0]["status"], rows[0]["first_token"], rows[0]["start"], rows[0]["end"]) == (A.EXACT, 11, 104, 115) and rows[1]["status"] is None and rows[1]["start"] is None


# --- evaluation ---


def sides(spark, seed=1, n=60):
    draw = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(12)]
    text = lambda: " ".join(draw.choice(words, draw.integers(1, 8)))
    gold = [(int(d), k, str(draw.choice(["goal", "risk"])), text(), {"category": "x"} if draw.random() < 0.5 else None, None) for k, d in enumerate(draw.integers(0, 6, n))]
    pred = []
    for k, (d, _, c, t, a, _) in enumerate(gold):
        if draw.random() < 0.85:
            w = t.split()
            if draw.random() < 0.5:
                w[draw.integers(0, len(w))] = str(draw.choice(words))
            pred.append((d, k, c if draw.random() < 0.8 else "goal", " ".join(w + (["extra"] if draw.random() < 0.2 else [])), a if draw.random() < 0.7 else {"category": "y"}, "match_exact"))
    make = lambda rows: E.normalised(spark.createDataFrame(rows, ROWS), False)
    return pred, gold, make(pred), make(gold)


def plain_counts(pred, gold, metric, cls=None):
    """tp by trying the matcher on a full matrix of each document."""
    kind, how = metric.split("_")
    tp = 0

    def weight(p, g):
        if kind != "detection" and p[2] != g[2]:
            return 0.0
        if kind == "structured" and not all(k in (g[4] or {}) and g[4][k] == v for k, v in (p[4] or {}).items()):
            return 0.0
        if how == "strict":
            return float(p[3] == g[3])
        a, b = p[3].split(), g[3].split()
        both = sum(min(a.count(t), b.count(t)) for t in set(a))
        x, y = both / len(a), both / len(b)
        f1 = 2 * x * y / (x + y) if both else 0.0
        run = max((n for n in range(1, min(len(a), len(b)) + 1) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        ok = (g[3] in p[3] and both / len(a) > 0.8) or (p[3] in g[3] and both / len(b) > 0.8) or (f1 > 0.8 and run / min(len(a), len(b)) > 0.7)
        return f1 if ok else 0.0

    for d in {r[0] for r in gold} & {r[0] for r in pred}:
        ps, gs = ([r for r in rows if r[0] == d and cls in (None, r[2])] for rows in (pred, gold))
        if ps and gs:
            tp += len(E._assign(np.array([[weight(p, g) for g in gs] for p in ps])))
    return tp


@pytest.mark.parametrize("metric", E.METRICS)
def test_metrics_against_plain_matching(spark, metric):
    pred, gold, p, g = sides(spark)
    docs, _ = E.scored_documents(p, g)
    total = E.micro(E.document_counts(p, g, docs, metric)).first()
    assert total["tp"] == plain_counts(pred, gold, metric) and total["tp"] + total["fp"] == len(pred) and total["tp"] > 0
    by = {r["class"]: r["tp"] for r in E.micro(E.document_counts(p, g, docs, metric, by_class=True), ("class",)).collect()}
    if metric.startswith("detection"):
        metric = "class_" + metric.split("_")[1]
    assert by == {c: plain_counts(pred, gold, metric, c) for c in by}


def test_assignment_is_optimal():
    draw = np.random.default_rng(4)
    for _ in range(120):
        w = np.where(draw.random((draw.integers(1, 6), draw.integers(1, 6))) < 0.6, draw.random(), 0) * draw.random((1, 1)) + 0.0
        w = w * draw.random(w.shape)
        short, long = sorted(w.shape)
        m = w if w.shape[0] == short else w.T
        best = max(sum(m[i, c[i]] for i in range(short)) for c in itertools.permutations(range(long), short))
        assert abs(sum(w[p] for p in E._assign(w)) - best) < 1e-9


def test_macro_errors_and_reports(spark):
    pred, gold, p, g = sides(spark)
    done = evaluation.evaluate(p, g, compatibility=False)
    counts = {r["bucket"]: r["n"] for r in E.bucket_counts(done.errors).collect()}
    docs, _ = E.scored_documents(p, g)
    relaxed = E.micro(E.document_counts(p, g, docs, "detection_relaxed")).first()
    assert counts.get("miss", 0) == relaxed["fn"] and counts.get("spurious", 0) == relaxed["fp"] and counts.get("text_drift", 0) == counts.get("class_error", 0)
    report = done.report()
    assert "## Micro Results" in report and "### Key Risks" in report
    change = evaluation.compare(done, evaluation.evaluate(g.withColumn("alignment_status", F.lit("match_exact")), g, compatibility=False))
    assert change.summary.first()["overall_assessment"] == E.VERDICTS[0] and "ΔF1=" in change.report()
    assert evaluation.check_metrics(["class_strict", "grounding_match_none_rate"]) == (["class_strict"], ["grounding_match_none_rate"])
    with pytest.raises(ValueError):
        evaluation.check_metrics(["odd"])
    assert evaluation.gate(done)["passed"]
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id int, domain string")
    assert {(r["doc_id"], r["problem"]) for r in E.dataset_problems(docs).collect()} == {(1, "duplicate_doc_id"), (2, "missing_domain")}


def test_swapped_thresholds(spark):
    make = lambda t: E.normalised(spark.createDataFrame([(1, 0, "a", t, None, None)], ROWS), False)
    long, short = make("a b c d e f g h i j"), make("a b c d e f g h i")
    tau = {"text_relaxed_f1": 0.99, "substring_recall": 0.95, "substring_precision": 0.5}
    assert E.legal_pairs(long, short, relaxed=True, thresholds=tau).count() == 0
    assert E.legal_pairs(short, long, relaxed=True, thresholds=tau).count() == 1


# --- evolution ---


def test_scores_and_routes(spark):
    hits = spark.createDataFrame([("q", "s1", "b1", 0.95, 1, "i"), ("q", "s2", "b1", 0.8, 2, "i"), ("q", "s3", "b2", 0.2, 3, "i")], "query_id string, signal_id string, bucket_id string, similarity double, rank int, index_name string")
    plain = V.bucket_scores(V.fused(hits), V.RouteConfig())
    assert all(r["score"] == 0 for r in plain.collect())  # fused scores never pass
    by = {r["bucket_id"]: r for r in V.bucket_scores(V.fused(hits), V.RouteConfig(similarity="cosine")).collect()}
    w = [(0.95 - 0.75) / 0.25, (0.8 - 0.75) / 0.25]
    assert by["b1"]["score"] == pytest.approx(np.log1p(sum(w) ** 2 / (w[0] ** 2 + w[1] ** 2 + 1e-9)) * sum(w)) and by["b1"]["high"] == 2 and by["b2"]["low"] == 1
    signals = spark.createDataFrame([("q",), ("new",)], "query_id string")
    routed = {r["query_id"]: r["bucket_id"] for r in V.routes(signals, V.bucket_scores(V.fused(hits), V.RouteConfig(similarity="cosine")), V.RouteConfig(threshold=0.5)).collect()}
    assert routed == {"q": "b1", "new": "bucket_new"}


def test_nearest_in_both_shapes(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 8))
    index = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(x)], "signal_id long, bucket_id int, vector array<double>")
    queries = index.where("signal_id < 5").select(F.col("signal_id").alias("query_id"), "vector")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = {k: [int(i) for i in np.argsort(-(u @ u[k]), kind="stable")[:4]] for k in range(5)}
    for block in (100, 1):
        found = {}
        for r in V.nearest(queries, index, 4, query_block=block).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["signal_id"])
        assert found == best


def test_embedding_and_signals(spark):
    rows = V.dense(V.hash_embedding(spark.createDataFrame([(1, "a b a"), (2, "")], "k int, t string"), "k", "t"), "k").collect()
    assert len(rows) == 1 and sum(v * v for v in rows[0]["vector"]) == pytest.approx(1)
    blocks = spark.createDataFrame([("d", 1, "text", ["h"])], "doc_ref string, block_id int, text string, tree array<string>")
    found = spark.createDataFrame([("d", 1, "new_attr", "r")], "doc_ref string, block_id int, conclusion string, reason string")
    assert V.build_signals(found, blocks).first()["source_embedding_text"] == "h\ntext"
    with pytest.raises(Exception, match="missing block"):
        V.build_signals(found.withColumn("block_id", F.lit(5)), blocks).collect()


def test_triage_and_proposals():
    class Model:
        def infer(self, prompts):
            turn = json.loads(prompts[0])
            if turn["turn"] == 0:
                return [json.dumps({"tools": [{"name": "look", "block_ids": [1, 2], "arguments": {}}]})]
            return [json.dumps({"conclusions": [{"block_id": b["block_id"], "conclusion": "noise", "reason": b["evidence"][0]} for b in turn["blocks"]]})]

    state = evolution.triage({1: "a", 2: "b"}, Model(), {"look": lambda ids, _: {k: f"seen {k}" for k in ids}})
    assert not state.active and state.budget == {1: 2, 2: 2} and [c["reason"] for c in state.conclusions] == ["seen 1", "seen 2"]

    class Draft:
        def infer(self, prompts):
            return [json.dumps({"name": "x", "again": json.loads(prompts[0])["feedback"]})]

    class Check:
        def infer(self, prompts):
            again = json.loads(prompts[0])["draft"]["again"]
            return [json.dumps({"accepted": again is not None, "reason": "once more"})]

    assert evolution.propose({"bucket_id": "b"}, Draft(), Check())["status"] == "stable"
    assert evolution.propose({"bucket_id": "b"}, Draft(), Check(), evolution.ProposalConfig(turns=1))["status"] == "ambiguous"
    assert evolution.check_arguments({"a": 1, "c": 2}, {"properties": {"a": {"type": "string"}}, "required": ["b"]}) == ["missing b", "a is no string", "unknown c"]


def test_document_tools(spark):
    docs = spark.createDataFrame([(1, "## H\nbefore block after\n## I\n")], "doc_id int, text string")
    blocks = spark.createDataFrame([(1, 0, 12, 17, "block", [])], "doc_id int, block_id int, start int, end int, text string, tree array<string>")
    spans = spark.createDataFrame([(1, "c", "after", 18, 23)], "doc_id int, class string, text string, start int, end int")
    tools = evolution.document_tools(docs, blocks, spans, 1, "small")
    assert json.loads(tools["neighbor_text"]([0], {})[0])["after"] == " after\n## I\n"
    assert json.loads(tools["neighbor_extractions"]([0], {})[0]) == [{"class": "c", "text": "after"}]
    assert tools["section_text"]([0], {"heading": "## H"})[0] == "## H\nbefore block after\n"


# --- inference and extraction ---


def test_extraction_end_to_end(spark):
    docs = spark.createDataFrame([(1, "Call 123 now. Then call 4567. Book of tales."), (2, "nothing"), (3, "")], "doc_id int, text string")
    rows = extraction.extract(docs, catalog._TEMPLATE, catalog._RULES, extraction.ExtractConfig(limit=20)).orderBy("chunk", "ord").collect()
    text = docs.first()["text"]
    assert [(r["class"], r["text"], r["status"], text[r["start"] : r["end"]]) for r in rows] == [("number", "123", "match_exact", "123"), ("number", "4567", "match_exact", "4567"), ("title", "Book of tales", "match_exact", "Book of tales")]
    twice = extraction.extract(docs, catalog._TEMPLATE, catalog._RULES, extraction.ExtractConfig(limit=20, passes=2))
    assert twice.count() == 3
    assert extraction.check_examples(catalog._TEMPLATE, A.AlignConfig()) == []
    with pytest.raises(ValueError):
        extraction.extract(docs, N.Template("x"), catalog._RULES)


def test_failing_model_and_memo(spark):
    class Bad:
        def infer(self, prompts):
            raise RuntimeError("down")

    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, prompt string")
    rows, news = N.infer(asked, Bad())
    assert [r["error"] for r in rows.collect()] == ["RuntimeError: down"] * 3 and news.count() == 0
    rows, news = N.infer(asked, N.Lookup({"p": "1", "q": "2"}))
    memo = news.select("cache_key", "output")
    again, fresh = N.infer(asked, Bad(), memo)
    assert sorted(r["output"] for r in again.collect()) == ["1", "1", "2"] and fresh.count() == 0 and news.count() == 2
    router = N.Router()
    router.register("ServiceA", lambda: "a", "^gpt", priority=1)
    router.register("ServiceB", lambda: "b", "^g")
    assert router.resolve("gpt-1")() == "a" and router.resolve("gx")() == "b" and router.named("serviceb")() == "b"
    with pytest.raises(ValueError):
        router.resolve("zzz")
    assert scan("").word == []
