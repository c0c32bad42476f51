"""Clashing names, repeated rows, null ids, long texts and ties, for the operators that give back whole rows."""

import corpus_pipeline
import pytest
from data import documents, frame, lines
from pyspark.sql import functions as F

from spanloom.llm import chat, lm, minhash, packing, pieces, quality, spotsigs, substring_dedup, tokens
from spanloom.llm.scratch import unused

BPE, SP = "byte_bpe_50k.json", "piece_bpe_32k.model"


def odd(spark, rows=None):
    """The documents with every name that the operators use for columns of their own."""
    out = frame(spark, rows)
    for c in ("_id", "_tag", "_new", "_stays", "_times", "_row", "_turn", "a.b"):
        out = out.withColumn(c, F.lit("x"))
    return out


def test_unused_names():
    assert unused(["_ID", "_id_"], "_id") == "_id__" and unused(["a"], "_id") == "_id"


def test_cleaned_and_keep_one_with_clashing_names(spark):
    plain = {(r["doc_id"], r["text"]) for r in substring_dedup.cleaned(frame(spark)).collect()}
    cut = substring_dedup.cleaned(odd(spark))
    assert cut.columns == odd(spark).columns and {(r["doc_id"], r["text"]) for r in cut.collect()} == plain
    kept = minhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and all(r["_turn"] == "x" and r["a.b"] == "x" for r in kept.collect())


def test_keep_one_of_repeated_and_null_ids(spark):
    rows = [(None, "same words here again and more")] * 7 + [(1, "one two three four five six")] * 40 + [(1, None)] + [(2, "one two three four five six")] + [(3, None)]
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(frame(spark, rows)).collect()]
    assert sum(i is None for i, _ in kept) == 7 and sum(i == 1 for i, _ in kept) == 1 and not any(i == 2 for i, _ in kept) and (3, None) in kept


TREES = "tree string, message string, parent string, role string, text string, score double"


def test_trees_with_keys_that_look_alike(spark):
    rows = [("a#1", "2", None, "user", "x", 0.0), ("a", "1#2", None, "user", "y", 0.0), ("a", "3", "1#2", "assistant", "z", 0.0), ("~", "1", None, "user", "p", 0.0), (None, "1", None, "user", "q", 0.0)]
    template = chat.ChatTemplate()
    done = chat.format_trees(spark.createDataFrame(rows, TREES), template).withColumn("turns", template.read_turns("formatted")).collect()
    assert {r["tree"]: [t["text"] for t in r["turns"]] for r in done} == {"a#1": ["x"], "a": ["y", "z"], "~": ["p"], None: ["q"]}


def test_repeated_messages_take_one_whole_row(spark):
    rows = [("t", "1", None, "user", "b", 1.0), ("t", "1", None, "assistant", "c", 0.0), ("t", "1", None, "user", "a", 5.0)]
    for order in (rows, rows[::-1]):
        one = chat.format_trees(spark.createDataFrame(order, TREES).repartition(3)).collect()
        assert len(one) == 1 and one[0]["formatted"] == "<|turn|>assistant\nc<|end|>\n" and one[0]["score"] == 0.0


def test_ranks_ties_and_a_deep_comb(spark):
    n = 60
    spine = [("t", k, k - 1 if k else None, "user", f"s{k}", 0.0) for k in range(n)]
    teeth = [("t", 1000 + k, k, "assistant", f"t{k}", float(k % 7)) for k in range(n - 1)]
    frame_ = spark.createDataFrame(spine + teeth, TREES.replace("message string, parent string", "message long, parent long")).withColumn("node", F.lit(1))
    best = chat.branches(frame_, 3).collect()
    ranked = sorted({(r["rank"], r["leaf"], r["score"]) for r in best})
    assert ranked == [(1, 1006, 6.0), (2, 1013, 6.0), (3, 1020, 6.0)]
    assert sorted((r["depth"], r["message"]) for r in best if r["rank"] == 2) == [*((k, k) for k in range(14)), (14, 1013)]
    every = {}
    for r in chat.branches(frame_).collect():
        every.setdefault(r["leaf"], []).append((r["depth"], r["message"]))
    assert len(every) == n and all([m for _, m in sorted(p)] == [*range(leaf - 999 if leaf >= 1000 else n - 1), leaf] for leaf, p in every.items())


def test_empty_tables(spark):
    none = frame(spark, [])
    for made in (tokens.token_counts(none, BPE), pieces.encode(none, SP), pieces.parity(none, SP), lm.scores(none), quality.keep_good(none), minhash.keep_one(none), substring_dedup.cleaned(none), packing.pack(none, BPE)):
        assert made.count() == 0
    prints = spotsigs.fingerprints(none).select("doc_id", "fingerprint")
    assert spotsigs.similar_pairs(prints).count() == 0


def test_similar_pairs_of_null_and_repeated_ids(spark):
    rows = [(None, "aa" * 4), (1, "aa" * 4), (1, "aa" * 4), (2, "aa" * 4 + "bb" * 4), (3, ""), (4, "aa" * 4 + "bb" * 4 + "cc" * 4)]
    found = spotsigs.similar_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string"), 0.5).collect()
    assert [(r["a"], r["b"], round(r["likeness"], 3)) for r in sorted(found)] == [(1, 2, 0.5), (2, 4, 0.667)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_take_every_case(spark, stage):
    name, run = stage
    for rows in (None, []):
        docs = odd(spark, rows)
        out = run(spark, docs, "")
        got = out.collect()
        if name != "packing":
            assert out.columns == [*docs.columns, *(["n_chars"] if name == "substrings" else [])]
        assert bool(got) == (rows is None)
        assert name == "packing" or {r["doc_id"] for r in got} <= {i for i, _ in documents()}


def test_long_texts_of_unlike_sizes(spark):
    long = lines(21, 30000)
    rows = [(1, long), (2, long.replace(" ", "  ")), (3, " ".join(reversed(long.split()))), (4, long[: len(long) // 2])]
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    assert quality.classify(frame(spark, [*rows, rows[0]])).count() == 5
    assert {r["n_chars"] for r in spotsigs.fingerprints(frame(spark, rows)).collect()} == {len(t) for _, t in rows}
    assert {r["n_tokens"] for r in lm.scores(frame(spark, rows)).collect()} == {len(t.split()) + 1 for _, t in rows}


def test_levels_double_and_stop(spark):
    assert substring_dedup.levels(35) == (9, 18, 35) and substring_dedup.levels(1) == (1,) and substring_dedup.levels(2) == (1, 2)
    assert all(b <= 2 * a for n in range(1, 80) for a, b in zip(substring_dedup.levels(n), substring_dedup.levels(n)[1:], strict=False))
    unlike = [(k, lines(100 + k, 60)) for k in range(5)]
    assert all(r["n_removed"] == 0 for r in substring_dedup.removed(frame(spark, unlike)).collect())


def test_hot_copies_and_passages(spark):
    passage = lines(31, 40)
    rows = [(k, f"{lines(200 + k, 3)} {passage} {lines(300 + k, 3)}") for k in range(30)] + [(100 + k, lines(32, 50)) for k in range(40)] + [(200, lines(33, 50))]
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removed(frame(spark, rows)).collect()}
    assert found == {k: 40 for k in range(30)} | {100 + k: 50 for k in range(40)} | {200: 0}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cleaned(frame(spark, rows)).collect()}
    assert all(len(left[k].split()) == 6 for k in range(30)) and all(left[100 + k] == "" for k in range(40)) and left[200] == lines(33, 50)


def test_blocks_by_bytes_give_the_same_groups(spark):
    import numpy as np

    draw, base = np.random.default_rng(7), lines(41, 80).split()
    rows = [(i, " ".join([f"x{draw.integers(9)}" if draw.random() < 0.06 else w for w in base])) for i in range(120)]
    of = lambda c: sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), c).collect())
    assert of(minhash.MinHashConfig(shingle=3)) == of(minhash.MinHashConfig(shingle=3, block_bytes=2000))
