"""A quality classifier without hand labels.

Overlapping heuristic labellers vote junk, clean or nothing on every text. Expectation-maximisation over the counts of
vote patterns estimates how often each labeller errs, and so the probability that a text of each pattern is junk.
Those posteriors train a linear scorer over hashed features, which then judges every text by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.scratch import Scratch

LABELLERS = ("symbols", "marks", "capitals", "neighbours", "top_word", "variety", "lines", "common_words")
JUNK, CLEAN, NONE = 1, 0, 2

#: Common words of the languages the labeller knows. Fixed values.
COMMON = frozenset(
    "the of and to in is was that for it on with as at by from this are or an be "
    "der die das und ist ein eine den von zu mit auf für nicht sich des im dem "
    "le la les de et un une du des en que pour dans qui sur pas au est "
    "el los las y del por con una se para su al lo como".split()
)


@dataclass(frozen=True)
class QualityConfig:
    """sample: most texts that the scorer is fitted on (drawn by hash); all others are counted and judged alike.
    bits: of the hashed feature space. reject: a text goes when its probability of junk is at least this."""

    sample: int = 6000
    bits: int = 18
    steps: int = 300
    reject: float = 0.5
    seed: int = 3


def _vote(junk: np.ndarray, clean: np.ndarray) -> np.ndarray:
    return np.where(junk, JUNK, np.where(clean, CLEAN, NONE)).astype(np.uint8)


def _classes() -> np.ndarray:
    """For each byte: 1 symbol, 2 capital, 4 small letter or part of a longer character."""
    table = np.zeros(256, dtype=np.uint8)
    for c in b"#$%&*@^~<>{}[]\\|=_":
        table[c] = 1
    table[65:91], table[97:123], table[128:] = 2, 4, 4
    return table


@dataclass(frozen=True)
class Words:
    """The words of all rows, split once for labellers and features: distinct ones, each place's, and row bounds."""

    listed: list[str]
    code: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(text: pa.Array) -> Words:
        flat, at = W.split(text)
        coded = flat.dictionary_encode()
        return Words(coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), at)


def votes(text: pa.Array, words: Words | None = None) -> np.ndarray:
    """One row per text and one column per labeller. Texts that are too short for a labeller get no vote of it."""
    words = words or Words.of(text)
    text = pc.fill_null(text, "")
    data = text.cast(pa.binary())
    raw, at = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8), np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))])
    kind = _classes()[raw]
    total = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)]) for k in (1, 2, 4)]
    symbols, capitals, small = (t[at[1:]] - t[at[:-1]] for t in total)
    marks = np.concatenate([[0], np.cumsum((raw == 124) | (raw == 33), dtype=np.int64)])
    marks = marks[at[1:]] - marks[at[:-1]]
    chars = np.maximum(np.diff(at), 1)
    bound, code = words.at, words.code
    n = np.diff(bound)
    known = np.array([w.strip(".,;:!?").lower() in COMMON for w in words.listed], dtype=bool)
    row = np.repeat(np.arange(len(n)), n)
    common = np.bincount(row, weights=known[code] if len(code) else None, minlength=len(n)) if len(code) else np.zeros(len(n))
    same = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row[1:][same], minlength=len(n)) if len(code) else np.zeros(len(n))
    top, distinct = np.zeros(len(n)), np.zeros(len(n))
    for k, (a, b) in enumerate(pairwise(bound)):
        if b > a:
            counts = np.unique(code[a:b], return_counts=True)[1]
            top[k], distinct[k] = counts.max(), len(counts)
    lines = pc.split_pattern(text, "\n")
    line_at = np.asarray(lines.offsets, dtype=np.int64)
    line_code = np.asarray(lines.flatten().dictionary_encode().indices, dtype=np.int64)
    line_at = line_at - line_at[0]
    unique_lines = np.array([len(np.unique(line_code[a:b])) for a, b in pairwise(line_at)])
    n_lines, m, letters = np.diff(line_at), np.maximum(n, 1), np.maximum(capitals + small, 1)
    long = n >= 20
    return np.stack(
        [
            _vote(symbols / chars >= 0.03, symbols / chars <= 0.004),
            _vote((marks / m >= 0.1) & (n >= 8), (marks / m <= 0.01) & long),
            _vote((capitals / letters >= 0.3) & (letters >= 60), (capitals / letters <= 0.1) & (letters >= 60)),
            _vote(long & (again / m >= 0.15), long & (again / m <= 0.04)),
            _vote(long & (top / m >= 0.15), long & (top / m <= 0.1)),
            _vote((n >= 60) & (distinct / m < 0.3), (n >= 60) & (distinct / m >= 0.5)),
            _vote((n_lines >= 3) & (unique_lines / n_lines <= 0.6), (n_lines >= 3) & (unique_lines / n_lines >= 0.9)),
            _vote((n >= 40) & (common / m < 0.02), long & (common / m >= 0.06)),
        ],
        axis=1,
    )


_DIGIT = np.array(["C", "J", "-"])


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, most=W.SLICE_BYTES // 2):
            yield pa.RecordBatch.from_arrays([part["id"], part["tag"], pa.array(["".join(_DIGIT[v]) for v in votes(part["text"])], type=pa.string())], names=["id", "tag", "pattern"])


def expectation_maximisation(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The probability of junk for each vote pattern, and for each labeller the estimated shares of right votes.

    Votes are taken as independent given the class; a labeller that doesn't vote says nothing. The start counts a text
    as junk when any labeller says so, which fixes which class is which.
    """
    if not patterns:
        return {}, [{"junk": 0.5, "clean": 0.5} for _ in LABELLERS]
    seen = np.array([list(p) for p, _ in patterns])
    weight = np.array([n for _, n in patterns], dtype=float)
    junk_vote, clean_vote = seen == "J", seen == "C"
    posterior = np.where(junk_vote.any(axis=1), 0.9, 0.05)
    for _ in range(rounds):
        before = posterior
        q = weight * posterior
        prior = np.clip((q.sum() + 1) / (weight.sum() + 2), 1e-4, 1 - 1e-4)
        # of the votes given on junk, the share that says junk; and of those on clean texts the share that says clean
        hit = np.clip(((q @ junk_vote) + 1) / ((q @ (junk_vote | clean_vote)) + 2), 1e-4, 1 - 1e-4)
        right = np.clip((((weight - q) @ clean_vote) + 1) / (((weight - q) @ (junk_vote | clean_vote)) + 2), 1e-4, 1 - 1e-4)
        odds = np.log(prior / (1 - prior)) + junk_vote @ np.log(hit / (1 - right)) + clean_vote @ np.log((1 - hit) / right)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    if (hit + right).mean() < 1:  # labellers that are worse than chance on the whole: the classes have changed places
        posterior, hit, right = 1 - posterior, 1 - right, 1 - hit
    return {p: float(x) for (p, _), x in zip(patterns, posterior, strict=True)}, [{"junk": float(a), "clean": float(b)} for a, b in zip(hit, right, strict=True)]


_RUNS = (re.compile(r"[a-zß-ɏ]+"), re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+"))


def _shape(word: str) -> str:
    """A word's kind: runs of small letters, capitals, digits and one mark become one sign each."""
    out = _RUNS[3].sub(r"\1\1", word)
    for k, sign in enumerate(("a", "A", "0")):
        out = _RUNS[k].sub(sign, out)
    return out


def features(text: pa.Array, bits: int, words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all texts: slots, values (shares of each text), and where each text's begin."""
    words = words or Words.of(text)
    listed, code, at = words.listed, words.code, words.at
    mask = (1 << bits) - 1
    shape = np.array([xxhash.xxh3_64_intdigest("s" + _shape(w)) & mask for w in listed], dtype=np.int64)
    own = np.array([xxhash.xxh3_64_intdigest("w" + w.lower()) & mask for w in listed], dtype=np.int64)
    repeat, fresh, often = (xxhash.xxh3_64_intdigest(x) & mask for x in ("repeat", "fresh", "often"))
    slots, values, starts = [], [], [0]
    for a, b in pairwise(at):
        if b == a:
            starts.append(starts[-1])
            continue
        word, times = np.unique(code[a:b], return_counts=True)
        again = float((code[a + 1 : b] == code[a : b - 1]).sum())
        # shapes and words each weigh as shares of the text, so length plays no part
        slot, place = np.unique(np.concatenate([shape[word], own[word], [repeat, fresh, often]]), return_inverse=True)
        share = np.concatenate([times / (b - a), np.sqrt(times) / (b - a), [2 * again / (b - a), min(1.0, len(word) / (b - a)), 2 * times.max() / (b - a) if b - a >= 20 else 0.0]])
        value = np.bincount(place, weights=share)
        slots.append(slot)
        values.append(value)
        starts.append(starts[-1] + len(slot))
    none = np.empty(0)
    return np.concatenate([none.astype(np.int64), *slots]), np.concatenate([none, *values]), np.array(starts)


def _featured(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 2):
                slot, value, at = features(part["text"], bits)
                packed = [[x[a:b].tobytes() for a, b in pairwise(at)] for x in (slot.astype("<i4"), value.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([part["tag"], part["pattern"], *(pa.array(x, type=pa.binary()) for x in packed)], names=["tag", "pattern", "slots", "vals"])

    return run


def fit_scorer(rows: list, posterior: dict[str, float], config: QualityConfig) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated full-batch gradient steps with adaptive rates."""
    weight, bias = np.zeros(1 << config.bits, dtype=np.float64), -2.0
    if not rows:
        return weight, bias
    label = np.array([posterior[r["pattern"]] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["slots"]) // 4 for r in rows])
    slot = np.frombuffer(b"".join(r["slots"] for r in rows), dtype="<i4")
    value = np.frombuffer(b"".join(r["vals"] for r in rows), dtype="<f4").astype(np.float64)
    # both classes weigh half
    share = np.clip(label.mean(), 0.02, 0.98)
    importance = label * (0.5 / share) + (1 - label) * (0.5 / (1 - share))
    squares, bias_squares = np.full(len(weight), 1e-8), 1e-8
    for _ in range(config.steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * weight[slot], minlength=len(rows)) + bias, -30, 30)))
        error = importance * (p - label) / len(rows)
        step = np.bincount(slot, weights=value * error[row], minlength=len(weight)) + 1e-6 * weight
        squares += step**2
        bias_squares += error.sum() ** 2
        weight -= 0.7 * step / np.sqrt(squares)
        bias -= 0.3 * error.sum() / np.sqrt(bias_squares)
    return weight, bias


def junk_probability(text: pa.Array, weight: np.ndarray, bias: float, bits: int, words: Words | None = None) -> np.ndarray:
    """By the scorer; 0 for texts without words."""
    slot, value, at = features(text, bits, words)
    odds = np.bincount(np.repeat(np.arange(len(text)), np.diff(at)), weights=value * weight[slot], minlength=len(text)) + bias
    return np.where(np.diff(at) > 0, np.round(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 6), 0.0)


def _scored(weight: np.ndarray, bias: float, config: QualityConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 2):
                words = Words.of(part["text"])
                junk = junk_probability(part["text"], weight, bias, config.bits, words)
                pattern = pa.array(["".join(_DIGIT[v]) for v in votes(part["text"], words)], type=pa.string())
                yield pa.RecordBatch.from_arrays([part["id"], part["tag"], pa.array(junk), pa.array(junk < config.reject), pattern], names=["id", "tag", "p_junk", "kept", "pattern"])

    return run


def _passed(weight: np.ndarray, bias: float, config: QualityConfig, text_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows whose texts aren't rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_column, W.SLICE_BYTES // 2):
                yield part.filter(pa.array(junk_probability(part[text_column], weight, bias, config.bits) < config.reject))

    return run


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def fit(texts: DataFrame, config: QualityConfig, scratch: Scratch) -> tuple[DataFrame, np.ndarray, float]:
    """The votes on all texts (id, tag, pattern), and the scorer's weights and bias."""
    voted = scratch.put(texts.mapInArrow(_voter, "id long, tag long, pattern string"), "votes")
    counts = [(r["pattern"], r["count"]) for r in voted.groupBy("pattern").count().orderBy("pattern").collect()]  # at most 3 to the number of labellers
    posterior, _ = expectation_maximisation(counts)
    drawn = voted.select("tag", "pattern").distinct().orderBy(F.xxhash64("tag", F.lit(config.seed)), "tag").limit(config.sample)
    fitted_on = texts.join(F.broadcast(drawn), "tag").dropDuplicates(["tag"]).select("tag", "pattern", "text")  # at most config.sample small rows
    rows = sorted(fitted_on.mapInArrow(_featured(config.bits), "tag long, pattern string, slots binary, vals binary").collect(), key=lambda r: r["tag"])
    weight, bias = fit_scorer(rows, posterior, config)
    return voted, weight.astype(np.float32), float(bias)


def classify(docs: DataFrame, config: QualityConfig | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tag, p_junk, kept, pattern) for each row of docs; tag is a hash of its text.

    pattern has a letter for each labeller: J, C or - (no vote). All rows are counted for the labellers' accuracies; the
    scorer is fitted on at most config.sample rows and judges all.

    Nulls: a null or empty text has no features, gets p_junk 0 and is kept; null ids and repeated rows are rows like
    others (equal texts get equal results). Other columns are ignored; an empty table gives an empty one.
    """
    config = config or QualityConfig()
    texts = _texts(docs, id_column, text_column)
    _, weight, bias = fit(texts, config, Scratch(docs.sparkSession, "quality"))
    scored = texts.mapInArrow(_scored(weight, bias, config), "id long, tag long, p_junk double, kept boolean, pattern string")
    return scored.withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, config: QualityConfig | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects. The rows are filtered where they lie, without a shuffle.

    Null and empty texts stay, as they have no features; null ids and repeated rows are rows like others; other columns
    stay as they are, whatever their names; an empty table stays empty."""
    config = config or QualityConfig()
    docs = docs if docs.schema[text_column].dataType.typeName() == "string" else docs.withColumn(text_column, F.col(text_column).cast("string"))
    _, weight, bias = fit(_texts(docs, id_column, text_column), config, Scratch(docs.sparkSession, "quality"))
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(_passed(weight, bias, config, f"c{docs.columns.index(text_column)}"), plain.schema).toDF(*docs.columns)
