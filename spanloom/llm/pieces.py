"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed, and its normaliser, white-space marker, scores or merges and byte fallback are rebuilt as
a tokenizers pipeline, which encodes batches with several threads. The rebuilt tokenizer is held against the
sentencepiece library on probes before it is used, and can be held against it on any table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.scratch import small_batches
from spanloom.llm.tokens import path_of

MARK = "▁"
#: Piece types, fixed values of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
CALL_BYTES = 512 << 10
LONG = 64 << 10

#: Runs of spaces, other white space, several scripts, bytes without a piece, strings of special pieces.
PROBES = ("", " ", "a", "  two  spaces ", " " * 40 + "x", "a" + " " * 18, "\ttab\nline\r\n", "Grüße, naïve façade — “quoted”", "日本語 と 한국어", "👩‍👩‍👧 \U0001d538 ﷺ \x00\x7f", "<s> </s> <unk> <0x41> ▁ mark", "ééé é", "aaaaaaaaaaaaaaaa", "The quick brown fox's 12345 jumps!")


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def _merges(model) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, best score first. Only ordinary pieces can be put together."""
    of = {p.piece: (-p.score, k) for k, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
    found = []
    for piece, rank in of.items():
        found += [(rank, cut, piece) for cut in range(1, len(piece)) if piece[:cut] in of and piece[cut:] in of]
    return [(piece[:cut], piece[cut:]) for _, cut, piece in sorted(found)]


def _bounds(model) -> str | None:
    """A pattern of stretches that no piece crosses, if the marker only ever begins pieces: the words with the marks
    before them. The longest run of marks that is a piece is cut from longer runs from the left, as scores of equal
    runs tie there."""
    plain = [p.piece for p in model.pieces if p.type == NORMAL]
    if any(MARK in p.lstrip(MARK) for p in plain):
        return None
    most = max((len(p) for p in plain if not p.strip(MARK)), default=1)
    if not all(MARK * k in set(plain) for k in range(1, most + 1)):
        return None
    return f"{MARK}{{{most}}}(?={MARK})|{MARK}{{0,{most}}}[^{MARK}]+|{MARK}+"


def rebuild(name: str):
    """A tokenizers tokenizer with the ids of the SentencePiece model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = _proto(path_of(name))
    trained, rules = model.trainer_spec, model.normalizer_spec
    vocabulary = {p.piece: k for k, p in enumerate(model.pieces)}
    unknown = model.pieces[trained.unk_id].piece
    if trained.model_type == 2:
        own = Tokenizer(models.BPE(vocabulary, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=trained.byte_fallback))
    elif trained.model_type == 1:
        own = Tokenizer(models.Unigram([(p.piece, p.score) for p in model.pieces], unk_id=trained.unk_id, byte_fallback=trained.byte_fallback))
    else:
        raise ValueError(f"{name}: only BPE and unigram models can be rebuilt")
    steps = []
    if rules.precompiled_charsmap:
        steps.append(normalizers.Precompiled(bytes(rules.precompiled_charsmap)))
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if rules.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if rules.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    own.normalizer = normalizers.Sequence(steps)
    bounds = _bounds(model) if trained.model_type == 2 else None
    if bounds:
        own.pre_tokenizer = pre_tokenizers.Split(Regex(bounds), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else []
    own.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return own


class Pieces:
    """Encoding and decoding of one model file."""

    def __init__(self, name: str, threads: int = 2) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.own = rebuild(name)
        rules = _proto(path_of(name)).normalizer_spec
        self.splits = rules.add_dummy_prefix and not rules.precompiled_charsmap and self.own.pre_tokenizer is not None
        wrong = [p for p, a, b in zip(PROBES, self.encode(list(PROBES)), self._peer(name, PROBES), strict=True) if list(a) != list(b)]
        if wrong:
            raise ValueError(f"{name}: the rebuilt tokenizer differs from the model on {wrong!r}")

    @staticmethod
    def _peer(name: str, texts) -> list[list[int]]:
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path_of(name)).encode(list(texts))

    def _parts(self, text: str) -> list[str]:
        """A long text is split at lone spaces. The prefix that each part gets stands for the space left out."""
        if len(text) <= LONG or not self.splits:
            return [text]
        out, at, lone = [], 0, re.compile(rf"(?<=[^ {MARK}]) (?=[^ {MARK}])")
        while len(text) - at > LONG:
            found = lone.search(text, at + LONG)
            if not found:
                break
            out.append(text[at : found.start()])
            at = found.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        parts = [self._parts(t) for t in texts]
        flat = [p for own in parts for p in own]
        ids: list[np.ndarray] = []
        at = size = 0
        for k, piece in enumerate(flat):
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= CALL_BYTES or k + 1 == len(flat):
                ids += [np.asarray(x.ids, dtype="<u4") for x in self.own.encode_batch_fast(flat[at : k + 1], add_special_tokens=False)]
                at, size = k + 1, 0
        out, at = [], 0
        for own in parts:
            out.append(ids[at] if len(own) == 1 else np.concatenate(ids[at : at + len(own)]))
            at += len(own)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        return self.own.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def pieces(name: str, threads: int = 2) -> Pieces:
    return Pieces(name, threads)


def _encoder(name: str, threads: int, ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name, threads)
        for batch in batches:
            for part in W.slices(batch, most=1 << 20):
                texts = part["text"].fill_null("").to_pylist()
                found = model.encode(texts)
                back = model.decode(found)
                columns = {
                    "id": part["id"],
                    "n_tokens": pa.array([len(x) for x in found], type=pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found], type=pa.int64()),
                    "decoded": pa.array(back, type=pa.string()),
                    "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)], type=pa.bool_()),
                }
                if ids:
                    at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, dtype="<u4"), *found]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def encode(docs: DataFrame, model: str, *, threads: int = 2, ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, decoded, round_trip[, ids]) for each row of docs, in one pass without a shuffle.

    Ids are those of the sentencepiece library for the model file (a path or the name of an installed public one),
    without begin and end. decoded is the text that they decode to, round_trip whether that is the text itself; a model
    whose normaliser changes texts has false there.

    Nulls: a null text counts as an empty one; ids may be null or repeated; other columns are ignored; an empty table
    gives an empty one.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_crc32 long, decoded string, round_trip boolean" + ", ids array<int>" * ids
    return texts.mapInArrow(_encoder(model, threads, ids), schema).withColumnRenamed("id", id_column)


def _holder(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, peer = pieces(name), sentencepiece.SentencePieceProcessor(model_file=path_of(name))
        for batch in batches:
            for part in W.slices(batch, most=1 << 20):
                texts = part["text"].fill_null("").to_pylist()
                ids = model.encode(texts)
                same = [a.tolist() == b and c == d for a, b, c, d in zip(ids, peer.encode(texts, num_threads=1), model.decode(ids), peer.decode([x.tolist() for x in ids]), strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(same, type=pa.bool_())], names=["id", "same"])

    return run


def parity(docs: DataFrame, model: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, same) for each row: do both libraries agree on its ids and on what they decode to?"""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(_holder(model), f"id {texts.schema['id'].dataType.simpleString()}, same boolean").withColumnRenamed("id", id_column)
