"""Registered queries without SQL over whole inputs, against plain loops on small tables."""

import re
from collections import Counter

from spanloom import catalog
from spanloom.operators import align as A
from spanloom.operators.chunks import sentence_chunks
from spanloom.operators.tokens import scan


def test_align_status_aligns_every_chunk(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    sentence = lambda k: " ".join([f"Word{k}", *words[k % 5 :], f"end{k}"]) + ".\n"
    texts = {1: "".join(map(sentence, range(20))), 2: "".join(map(sentence, range(3, 9))), 3: "Short one.", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    wanted, chunks = {}, {}
    for doc, text in texts.items():
        tokens = scan(text or "")
        chunks[doc] = sentence_chunks(tokens, 300)
        for chunk, (a, b) in enumerate(chunks[doc]):
            start, end = int(tokens.start[a]), int(tokens.end[b - 1])
            w = re.sub(r"\s+", " ", text[start:end]).split(" ")
            asked = [" ".join(w[:3]), " ".join(w[3:7]) + " zzzz", " ".join(x + "s" for x in w[8:11]), "qqqq xxxx"]
            for k, (status, _, _, s, e) in enumerate(A.align(text[start:end], asked, A.AlignConfig())):
                wanted[doc, chunk, k] = (status, None if s is None else s + start, None if e is None else e + start)
    assert len(chunks[1]) > 3 and len(chunks[2]) > 1
    rows = catalog.QUERIES["align_status"](spark, str(tmp_path)).collect()
    assert len(rows) == len(wanted) and {(r["doc_id"], r["chunk"], r["ord"]): (r["status"], r["start"], r["end"]) for r in rows} == wanted


def test_neighbor_extractions_all_takes_every_span_as_a_block(spark, tmp_path):
    texts = {1: "x" * 5000, 2: "y" * 300, 3: "z" * 40, 4: "", 5: None, 6: "w" * 12000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {}
    for doc, text in texts.items():
        n = len(text or "")
        at = [(doc * 37 + k * 211) % max(n, 1) for k in range(6)]
        spans = [(a, min(n, a + 20 + (doc * 13 + k * 7) % 80)) for k, a in enumerate(at)]
        for k, (a, b) in enumerate(spans):
            wanted[doc, k] = sum(s < b + 100 and max(a - 100, 0) < e and s < e for s, e in spans)
    rows = catalog.QUERIES["neighbor_extractions"](spark, str(tmp_path)).collect()
    assert len(rows) == len(wanted) == 36 and {(r["doc_id"], r["block_id"]): r["n"] for r in rows} == wanted


def test_token_overlap_pairs_whole_measures_whole_turns(spark, tmp_path):
    words = "One two Three four two five six. Seven, eight nine ten eleven".split()
    rows = [(c, t, "user", " ".join(words[(c + t + k) % len(words)] for k in range(4 * t + 40))) for c in range(2) for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    tokens = lambda x: Counter(re.findall(r"[A-Za-z0-9_.:/-]+|\S", x.lower().strip()))
    wanted = {}
    for c, t, _, text in rows:
        other = text.lower() if t % 5 == 0 else text[:-10] if t % 4 == 3 else text
        a, b = tokens(text), tokens(other)
        n = (a & b).total()
        wanted[c, t] = (n, round(n / a.total(), 6), round(n / b.total(), 6))
    found = catalog.QUERIES["token_overlap_pairs"](spark, str(tmp_path)).collect()
    assert len(found) == len(wanted) and {(r["doc_id"], r["idx"]): (r["shared"], r["over_a"], r["over_b"]) for r in found} == wanted


def test_heading_asof_all_takes_every_span_as_a_state(spark, tmp_path):
    texts = {1: "x" * 5000, 2: "y" * 300, 3: "z" * 40, 4: "", 5: None, 6: "w" * 12000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {(d, k): f"state {min(5, ((d * 37 + k * 211) % max(len(t or ''), 1)) // 100)}" for d, t in texts.items() for k in range(6)}
    rows = catalog.QUERIES["heading_asof"](spark, str(tmp_path)).collect()
    assert len(rows) == len(wanted) == 36 and {(r["doc_id"], r["span_id"]): r["state"] for r in rows} == wanted
