import numpy as np
import pytest
from data import frame, lines

from spanloom.llm import lattice, minhash


@pytest.mark.parametrize("n", [2, 8, 16, 24, 32, 40, 64])
def test_lattice_recall_at_the_threshold_for_short_vectors(n):
    draw, config = np.random.default_rng(n), lattice.LatticeConfig()
    u, v = draw.normal(size=(2, 3000, n))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(axis=1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    (h1, p1), (h2, p2) = lattice.cells(u, config), lattice.cells(0.9 * u + np.sqrt(1 - 0.81) * v, config)
    met = (h1 == h2) | (p1 == h2[:, :, None]).any(axis=2) | (p2 == h1[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.99


def near(text: str, at: int) -> str:
    words = text.split()
    return " ".join([*words[:at], f"changed{at}", *words[at + 1 :]])


def row_groups(rows):
    """The least id of each row's group, rows being linked by their texts alone."""
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    of = list(range(len(rows)))
    for x, a in enumerate(sets):
        for y in range(x):
            if 100 * len(a & sets[y]) >= 85 * len(a | sets[y]):
                of = [of[y] if o == of[x] else o for o in of]
    return sorted((i, len(a), min(rows[y][0] for y in range(len(rows)) if of[y] == of[x])) for x, ((i, _), a) in enumerate(zip(rows, sets, strict=True)))


def test_minhash_one_id_with_two_texts_links_the_near_copies_of_both(spark):
    a, b, c = (lines(k, 120) for k in (1, 2, 3))
    rows = [(1, a), (1, b), (1, a), (2, near(a, 50)), (3, near(b, 60)), (4, near(near(b, 60), 20)), (5, b), (6, c), (6, lines(4, 30)), (7, near(c, 10)), (0, near(c, 90)), (8, near(lines(4, 30), 29))]
    for block in (4096, 2):
        found = minhash.near_duplicates(frame(spark, rows), minhash.MinHashConfig(shingle=3, percent=85, block=block)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == row_groups(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
