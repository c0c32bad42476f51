"""The classifier's parts against plain loops."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from data import documents

from spanloom.llm import quality


def plain_em(patterns, rounds=200):
    rows = [(p, n, 0.9 if "J" in p else 0.05) for p, n in patterns]
    for _ in range(rounds):
        q = sum(n * x for _, n, x in rows)
        total = sum(n for _, n, _ in rows)
        prior = min(max((q + 1) / (total + 2), 1e-4), 1 - 1e-4)
        hit, right = [], []
        for k in range(len(rows[0][0])):
            junk = sum(n * x for p, n, x in rows if p[k] == "J")
            both = sum(n * x for p, n, x in rows if p[k] != "-")
            clean = sum(n * (1 - x) for p, n, x in rows if p[k] == "C")
            all_ = sum(n * (1 - x) for p, n, x in rows if p[k] != "-")
            hit.append(min(max((junk + 1) / (both + 2), 1e-4), 1 - 1e-4))
            right.append(min(max((clean + 1) / (all_ + 2), 1e-4), 1 - 1e-4))
        new = []
        for p, n, _ in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(h / (1 - r)) if c == "J" else math.log((1 - h) / r) if c == "C" else 0 for c, h, r in zip(p, hit, right, strict=True))
            new.append((p, n, 1 / (1 + math.exp(-min(max(odds, -30), 30)))))
        rows = new
    return {p: x for p, _, x in rows}


def test_em_against_plain_sums():
    draw = np.random.default_rng(2)
    patterns = sorted(Counter("".join(draw.choice(list("JC-"), 4, p=(0.2, 0.5, 0.3))) for _ in range(500)).items())
    posterior, _ = quality.expectation_maximisation(patterns)
    assert posterior == pytest.approx(plain_em(patterns), abs=1e-6)


def test_features_of_each_text_alone():
    texts = [t for _, t in documents()]
    slot, value, at = quality.features(pa.array(texts), 18)
    for k, t in enumerate(texts):
        own = quality.features(pa.array([t], type=pa.string()), 18)
        assert own[0].tolist() == slot[at[k] : at[k + 1]].tolist() and own[1] == pytest.approx(value[at[k] : at[k + 1]], rel=1e-9)
    words = quality.Words.of(pa.array(texts))
    assert (quality.votes(pa.array(texts), words) == quality.votes(pa.array(texts))).all()


def test_a_shape_is_of_the_whole_word():
    assert quality._shape("Ab1cd-EF22.g+++h") == "Aa0a-A0.a++a" and quality._shape("a.b.c.d.e.f.g.h9") == "a.a.a.a.a.a.a.a0"


def test_scorer_against_a_plain_sum():
    weight = np.random.default_rng(1).normal(size=1 << 18).astype(np.float32)
    texts = pa.array(["one two two three", "", None, "a b c d e f"])
    slot, value, at = quality.features(texts, 18)
    found = quality.junk_probability(texts, weight, 0.3, 18)
    for k in range(4):
        odds = sum(float(v) * float(weight[s]) for s, v in zip(slot[at[k] : at[k + 1]], value[at[k] : at[k + 1]], strict=True)) + 0.3
        assert found[k] == pytest.approx(0.0 if at[k] == at[k + 1] else 1 / (1 + math.exp(-odds)), abs=1e-6)
