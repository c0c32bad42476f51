import hashlib
from collections import Counter

import numpy as np
from data import frame

import corpus_pipeline
from spanloom.llm import lattice, queries
from spanloom.llm.minhash import MinHashConfig, near_duplicates

SF = "/root/testdata/sf0.001"


def brute_links(rows, least=0.9):
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v) != 0)]
    usable = [(i, v / np.linalg.norm(v)) for i, v in usable]
    links, parent = Counter(), {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(usable):
        for j, b in usable[:k]:
            if len(a) == len(b) and a @ b >= least:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i in parent}


def vectors():
    draw = np.random.default_rng(9)
    near = draw.normal(size=32)
    rows = [(k, draw.normal(size=32).tolist()) for k in range(60)]
    rows += [(100 + k, (near + draw.normal(size=32) * 0.12).tolist()) for k in range(40)]
    rows += [(200 + k, near.tolist()) for k in range(5)]
    return rows + [(300, None), (301, []), (302, [0.0] * 32), (303, [None] + [1.0] * 31), (304, [float("nan")] * 32), (305, near[:8].tolist()), (306, near[:8].tolist()), (307, (near * 1e-30).tolist()), (308, (-near).tolist())]


def test_lattice_against_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in [*rows, (None, rows[0][1])]], "vec_id long, embedding array<float>, node int, cell int")
    for block in (1024, 7):
        found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.linked_vectors(table, lattice.LatticeConfig(block=block)).collect()}
        assert found.pop(None) == (0, None)
        assert found == brute_links(rows)
    assert lattice.linked_vectors(table.where("false")).count() == 0


def test_lattice_recall_at_the_threshold():
    draw, config = np.random.default_rng(1), lattice.LatticeConfig()
    u, v = draw.normal(size=(2, 1500, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(axis=1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    (h1, p1), (h2, p2) = lattice.cells(u, config), lattice.cells(0.9 * u + np.sqrt(1 - 0.81) * v, config)
    met = (h1 == h2) | (p1 == h2[:, :, None]).any(axis=2) | (p2 == h1[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.98


def test_e8_decoding_is_nearest():
    draw, short = np.random.default_rng(2), lattice.roots()
    assert len(short) == 240 and np.allclose((short**2).sum(axis=1), 2)
    x = draw.normal(size=(500, 8)) * 2
    point = lattice.e8(x)
    best = ((x - point) ** 2).sum(axis=1)
    assert all((((x - point - r) ** 2).sum(axis=1) >= best - 1e-9).all() for r in short)
    assert (np.abs(point.sum(axis=1) % 2) < 1e-9).all()


def test_queries_have_results(spark):
    for name in ("op1_spotsigs", "op4_token_counts", "op10_lattice"):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    good, single, cut, packed = kept
    groups = {r["doc_id"]: r["component_id"] for r in near_duplicates(good, MinHashConfig()).collect()}
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in groups.items() if i == c}
    texts = [(r["doc_id"], r["text"].split()) for r in single.collect()]
    count = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    for i, w in texts:
        gone = {k + d for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for d in range(35)}
        assert left[i].split() == [x for k, x in enumerate(w) if k not in gone]
    assert {r["doc_id"] for r in packed.collect()} == set(left)
    fill = Counter()
    for r in packed.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024


def test_pipeline_run_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r["doc_id"] for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    junk = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in good for i in clean) >= 0.98 * len(clean) and sum(i in good for i in junk) <= 0.1 * len(junk)


def test_hash_of_nothing(spark):
    row = frame(spark, [(1, None)]).first()
    assert row["text"] is None and hashlib.sha256(b"").hexdigest().startswith("e3b0")
