import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from data import documents, frame, words

from spanloom.llm import chat, lm, minhash, packing, pieces, quality, spotsigs, substring_dedup, tokens
from spanloom.llm.components import connected_components
from spanloom.llm.scratch import Scratch

BPE, SP = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- components ---


def test_components_match_union_find(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000 + k) for k in range(200)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# --- minhash ---


def brute_groups(rows, n, percent):
    sets = []
    for i, t in rows:
        w = words(t, lower=True)
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    ids = {i: i for i, _ in sets if i is not None}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    live = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(live):
        for j, b in live[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                ids[max(p, q)] = min(p, q)
    return {(i, len(s), None if i is None else root(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_minhash_against_brute_force(spark, n, percent):
    found = rows_of(minhash.near_duplicates(frame(spark), minhash.MinHashConfig(shingle=n, percent=percent)))
    assert len(found) == len(documents())
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_groups(documents(), n, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)


def test_minhash_groups_of_many_near_copies(spark):
    draw, base = np.random.default_rng(5), [f"w{k}" for k in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(draw.integers(0, 6)):
            w[draw.integers(0, 60)] = f"x{draw.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    for block in (4096, 16):  # one block, and many small ones
        found = minhash.near_duplicates(frame(spark, rows), minhash.MinHashConfig(shingle=3, percent=85, block=block)).collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_groups(rows, 3, 85)


def test_minhash_empty_and_keep_one(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.keep_one(frame(spark), minhash.MinHashConfig(shingle=3, percent=85))
    assert kept.columns == frame(spark).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(None) == 2 and 2 not in ids and 3 not in ids and 1 in ids and ids.count(15) == 0


# --- substring ---


def brute_removed(rows, n):
    split = [words(t) for _, t in rows]
    count = Counter(tuple(w[k : k + n]) for w in split for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


@pytest.mark.parametrize("n", [35, 8, 2, 1])
def test_substring_against_brute_force(spark, n):
    found = substring_dedup.removed(frame(spark), n).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == brute_removed(documents(), n)


def test_substring_random_tables(spark):
    draw = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{x}" for x in draw.integers(0, 4, draw.integers(0, 90)))) for k in range(60)]
    found = substring_dedup.removed(frame(spark, rows), 7).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == brute_removed(rows, 7)
    assert substring_dedup.removed(frame(spark, [])).count() == 0


def test_cleaned_texts(spark):
    out = substring_dedup.cleaned(frame(spark), 35)
    assert out.columns == frame(spark).columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "" and texts[5] is None and texts[7] == " \t\n " and texts[13] == dict(documents())[13]
    assert texts[14] == "x"


# --- tokens, pieces, packing ---


def test_token_counts(spark):
    library = tokens.library(BPE)
    found = rows_of(tokens.token_counts(frame(spark), BPE))
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in documents())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)
    long = documents()[12][1] * 12
    assert tokens.count_tokens([long, "a<|endoftext|>b"], BPE) == [len(library.encode(long).ids), 3]
    assert tokens.count_tokens(["a b", ""], SP) == [len(x) for x in tokens.library(SP).encode(["a b", ""])]


def test_encoder_agrees_with_the_library():
    encode, library = tokens.encoder(BPE), tokens.library(BPE)
    marks = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x20AC, 0x3000, 0x4E00, 0x1F600)]
    texts = [x for c in marks for x in (c, f"a{c}b", f"a {c} 1{c}2", f"{c}{c}  {c}\n{c} x", f"'{c}s'{c}re")] + [t or "" for _, t in documents()] + ["a<|endoftext|>b", "y" * 3000 + " z"]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(encode(text)) == found.ids, repr(text)


def test_pieces_agree_with_sentencepiece(spark):
    assert all(r["same"] for r in pieces.parity(frame(spark), SP).collect())
    found = rows_of(pieces.encode(frame(spark), SP))
    assert all(r["round_trip"] for r in found) and len(found) == len(documents())
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["n_tokens"] for r in found)
    model, peer = pieces.pieces(SP), tokens.library(SP)
    texts = [" " * k + "ab" for k in range(40)] + ["a" + " " * k for k in range(40)] + [" ".join(["long text é"] * 9000)]
    assert [x.tolist() for x in model.encode(texts)] == peer.encode(texts)


def test_packing(spark):
    library = tokens.library(BPE)
    for size, rounds in ((1 << 17, 4), (3, 3)):
        found = rows_of(packing.pack(frame(spark), BPE, capacity=64, partition_pieces=size, rounds=rounds))
        expected = Counter()
        for i, t in documents():
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            at = 0
            for k, n in enumerate([len(ids) % 64] * (len(ids) % 64 > 0) + [64] * (len(ids) // 64)):
                expected[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
                at += n
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
        bins = {}
        for r in sorted(found, key=lambda r: r["offset"]):
            assert bins.get(r["sequence_id"], 0) == r["offset"]
            bins[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(bins.values()) <= 64
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_bounds_and_best_fit():
    draw = np.random.default_rng(1)
    for _ in range(200):
        capacity = int(draw.integers(4, 40))
        length = np.sort(draw.integers(1, capacity + 1, draw.integers(1, 60)))[::-1]
        bins, place, used = packing.best_fit(length, capacity)
        fill = np.bincount(bins, weights=length, minlength=used)
        assert fill.max() <= capacity and len(fill) == used
        assert packing.lower_bound(np.bincount(length, minlength=capacity + 1), capacity) <= used
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5


# --- spotsigs ---


def test_spotsigs(spark):
    found = rows_of(spotsigs.fingerprints(frame(spark)))
    assert len(found) == len(documents())
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    unique = [r for r in rows if r[0] is not None]
    after = {r[0]: unique[(k + 1) % len(unique)][1] or "" for k, r in enumerate(unique) if k + 1 < len(unique)}
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i, text in unique:
        text = text or ""
        assert by[i]["n_chars"] == len(text) and 0 <= by[i]["near_edited"] <= 1
        if i in after and i != 15:
            cut = len(text) // 4
            assert by[i]["edited_sha256"] == sha(text[: len(text) - cut] + after[i][:cut])
    assert by[1]["fingerprint"] == by[3]["fingerprint"] != by[2]["fingerprint"]
    one = rows_of(spotsigs.fingerprints(frame(spark, [(4, "the cat sat on the mat")])))
    assert one[0]["near_next"] == 1.0 and spotsigs.fingerprints(frame(spark, [])).count() == 0


def test_spotsigs_pairs(spark):
    draw = np.random.default_rng(2)
    vocabulary = [f"word{k}" for k in range(30)] + ["the", "of", "and"] * 8
    base = [list(draw.choice(vocabulary, 80)) for _ in range(6)]
    rows = []
    for k in range(60):
        w = list(base[k % 6])
        for _ in range(draw.integers(0, 5)):
            w[draw.integers(0, 80)] = str(draw.choice(vocabulary))
        rows.append((k, " ".join(w)))
    prints = spotsigs.fingerprints(frame(spark, rows)).select("doc_id", "fingerprint")
    sets, seen = {}, {}
    for r in sorted(prints.collect()):
        if r[1] and r[1] not in seen:
            seen[r[1]] = r[0]
            sets[r[0]] = {r[1][k : k + 8] for k in range(0, len(r[1]), 8)}
    brute = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in spotsigs.similar_pairs(prints, 0.8).collect()} == brute and brute


# --- language model ---


def test_lm_against_plain_counts(spark):
    found = rows_of(lm.scores(frame(spark)))
    text = [(i, [*words(t, lower=True), "\n"], i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in documents()]
    uni, bi = Counter(), Counter()
    for _, w, out in text:
        if not out:
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    total, size, follow = sum(uni.values()), len(uni), Counter(b for _, b in bi)
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, u = lm.discounts(of(bi)), lm.discounts(of(follow))
    left = sum(u[min(c, 3) - 1] for c in follow.values()) / len(bi)
    single = lambda w: max(follow[w] - (u[min(follow[w], 3) - 1] if follow[w] else 0), 0) / len(bi) + left / (size + 1)
    heads = {}
    for (a, _), c in bi.items():
        heads.setdefault(a, []).append(c)

    def p(a, b):
        if a not in heads:
            return single(b)
        n, c = sum(heads[a]), bi[(a, b)]
        return (c - (d[min(c, 3) - 1] if c else 0)) / n + sum(d[min(x, 3) - 1] for x in heads[a]) / n * single(b)

    expected = Counter((i, out, len(w), sum(x in uni for x in w), total, round(sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w), 6), round(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w, strict=False)), 6)) for i, w, out in text)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found) == expected
    assert sum(p("one", w) for w in uni) + p("one", "unseen word") == pytest.approx(1)


def test_lm_buckets_follow_the_text(spark, monkeypatch):
    size = sum(len((t or "").encode()) for _, t in documents())
    monkeypatch.setattr(lm, "BUCKET_TEXT", size // 7)
    made = lm.fit(frame(spark).select("text"), Scratch(spark, "lm"))
    assert made.vocabulary.buckets > int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = lambda rows: sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows)
    many = rows_of(lm.scores(frame(spark)))
    monkeypatch.undo()
    assert near(many) == near(rows_of(lm.scores(frame(spark))))


def test_lm_without_training_rows(spark):
    one = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    row = rows_of(lm.scores(frame(spark, [(one, "a b c")])))[0]
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == 0.0
    assert lm.scores(frame(spark, [])).count() == 0


# --- quality ---


def test_em_finds_the_better_labeller():
    draw = np.random.default_rng(4)
    rows = []
    for _ in range(4000):
        junk = draw.random() < 0.3
        rows.append("".join("JC"[int((draw.random() < e) == junk)] if draw.random() < 0.8 else "-" for e in (0.05, 0.1, 0.15, 0.3)))
    posterior, accuracy = quality.expectation_maximisation(sorted(Counter(rows).items()))
    assert accuracy[0]["junk"] > accuracy[3]["junk"] and abs(accuracy[0]["junk"] - 0.95) < 0.05 and posterior["JJJJ"] > 0.95 > 0.05 > posterior["CCCC"]


def test_quality(spark):
    clean = [(k, " ".join(w + (" the of and" if j % 3 == 0 else "") for j, w in enumerate(documents()[12][1].split()[k * 30 : k * 30 + 60]))) for k in range(60)]
    junk = [(100 + k, " ".join(f"ab{k}###" if j % 2 else "cd$$$" for j in range(50))) for k in range(12)]
    found = {r["doc_id"]: r for r in rows_of(quality.classify(frame(spark, clean + junk + [(200, None), (201, ""), (None, clean[0][1])])))}
    assert not any(found[i]["kept"] for i, _ in junk) and all(found[i]["kept"] for i, _ in clean) and found[200]["kept"] and found[201]["kept"] and found[None]["kept"]
    kept = quality.keep_good(frame(spark, clean + junk))
    assert kept.columns == frame(spark).columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in clean}
    assert quality.classify(frame(spark, [])).count() == 0


# --- chat ---


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "hi & <|turn|>\nx", 0.0), (1, 2, 1, "assistant", "a[1]", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", None, 5.0), (1, 5, 3, "user", "d", 0.5),
        (1, 6, 99, "user", "orphan", 0.0), (2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0), (None, 1, None, None, "n", 0.0), (1, 5, 3, "user", "d", 0.5),
    ]
    frame_ = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.branches(frame_).collect():
        paths.setdefault((r["tree"], r["leaf"], r["rank"], r["score"]), []).append((r["depth"], r["message"]))
    assert {k: [m for _, m in sorted(v)] for k, v in paths.items()} == {(1, 4, 1, 6.0): [1, 2, 4], (1, 5, 2, 3.5): [1, 3, 5], (1, 6, 3, 0.0): [6], (None, 1, 1, 0.0): [1]}
    template = chat.ChatTemplate()
    done = chat.format_trees(frame_, template, keep=1).withColumn("back", template.read_turns("formatted"))
    best = {r["tree"]: r for r in done.collect()}
    assert [(t["role"], t["text"]) for t in best[1]["back"]] == [("user", "hi & <|turn|>\nx"), ("assistant", "a[1]"), ("user", "")]
    assert [best[1]["formatted"][s["start"] : s["start"] + s["length"]] for s in best[1]["loss"]] == ["a&#91;1]"]
    assert chat.format_trees(frame_.where("false")).count() == 0


def test_long_chain(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(130)]
    done = chat.format_trees(chat.chain(spark.createDataFrame(rows, "c long, k long, r string, x string"), "c", "k", "r", "x")).collect()
    assert len(done) == 1 and done[0]["formatted"].count("<|turn|>") == 130 and len(done[0]["loss"]) == 65
