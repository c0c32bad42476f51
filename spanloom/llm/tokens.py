"""Token counts and ids with public tokenizer files.

Counts come from the tokenizers library (.json) or sentencepiece (.model) in batches balanced by bytes; long texts are
split where no token can cross. Ids of byte-level BPE files may come from a faster engine over the same merges: it is
used only for texts on which both provably agree, all others go through the library of the file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.scratch import small_batches

#: Bytes of one call of a tokenizer, and the length from which a text is split.
CALL_BYTES = 256 << 10
LONG_BYTES = 64 << 10

#: The split pattern of byte-level BPE files without one of their own. Fixed value of the file format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that every Unicode version since 4.0 classifies alike.
_SETTLED = re.compile("[\x00-ƺ‐-‧€]*")
#: Texts that both engines must encode alike before the faster one is used.
_PROBES = (
    "", " ", "a", "\n\n \t x", "It's we'LL they'd 12 345,678.9", "Ünïcödé straße Łódź ‘quoted’ — 5 €", "  two  spaces   three \r\n",
    "\x00\x01\x7f", "x" * 300, "ab1!" * 200, "!!!???...", "http://example.org/a_b?c=d&e=f#g", "the of and to in " * 40,
)
_BREAK = re.compile(r"(?<=[^\s]) (?=[^\s])")


def path_of(name: str) -> str:
    """A path stays; a bare name is looked up among the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    """The tokenizer of a .json or .model file; one for each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = path_of(name)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _splits_at_spaces(name: str) -> bool:
    """Is a lone space between two other characters always the start of a token of this file?"""
    path = path_of(name)
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
    return plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


def parts(text: str, name: str, most: int = LONG_BYTES) -> list[str]:
    """The text in parts of about `most` characters whose tokens together are the text's."""
    if len(text) <= most or not _splits_at_spaces(name):
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        found = _BREAK.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def count_tokens(texts: list[str], name: str) -> list[int]:
    """Tokens of each text, without begin, end or other added special tokens."""
    tokenizer = library(name)
    pieces, owner = [], []
    for k, text in enumerate(texts):
        for part in parts(text, name):
            pieces.append(part)
            owner.append(k)
    out = np.zeros(len(texts), dtype=np.int64)
    for a, b in _calls(pieces):
        if path_of(name).endswith(".model"):
            lengths = [len(x) for x in tokenizer.encode(pieces[a:b], num_threads=1)]
        else:
            lengths = [len(x) for x in tokenizer.encode_batch_fast(pieces[a:b], add_special_tokens=False)]
        np.add.at(out, owner[a:b], lengths)
    return out.tolist()


def _calls(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about CALL_BYTES of UTF-8."""
    at, size = 0, 0
    for k, piece in enumerate(pieces):
        size += len(piece) if piece.isascii() else len(piece.encode())
        if size >= CALL_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(pieces):
        yield at, len(pieces)


def _counter(name: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                text = pc.fill_null(part["text"], "")
                n = pa.array(count_tokens(text.to_pylist(), name), type=pa.int64())
                yield pa.RecordBatch.from_arrays([part["id"], pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row: one pass, no shuffle, lengths only leave the workers.

    tokenizer: a path, or the bare name of an installed public tokenizer. Strings of special tokens inside texts are
    treated as the library does by default. A null text counts as an empty one; ids may be null or repeated; other
    columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    counted = texts.mapInArrow(_counter(tokenizer, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)


class Encoder:
    """Ids of texts as the tokenizers library gives them for a .json file, without added special tokens."""

    def __init__(self, name: str) -> None:
        self.library = library(name)
        self.name = name
        with open(path_of(name), encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.engine = self._same_merges(spec) if _splits_at_spaces(name) else None
        self.engine = self._checked()

    @staticmethod
    def _same_merges(spec: dict):
        """The faster engine, if the file is plain byte-level BPE whose ids follow the order of its merges."""
        model = spec["model"]
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or odd:
            return None
        shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        specials = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in specials}
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
        if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(vocabulary):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _checked(self):
        """The engine, unless it differs from the library on a probe."""
        if self.engine:
            for probe, found in zip(_PROBES, self.library.encode_batch_fast(list(_PROBES), add_special_tokens=False), strict=True):
                if self.engine.encode(probe, disallowed_special=()) != found.ids:
                    return None
        return self.engine

    def __call__(self, text: str) -> np.ndarray:
        if self.engine and (text.isascii() or _SETTLED.fullmatch(text)) and not any(s in text for s in self.special):
            try:
                return self.engine.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern matcher gives up on endless white space
                pass
        found = self.library.encode_batch_fast(parts(text, self.name), add_special_tokens=False)
        return np.concatenate([np.asarray(x.ids, dtype=np.uint32) for x in found])


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)
