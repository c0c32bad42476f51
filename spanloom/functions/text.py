"""Text functions as Column expressions. Offsets are code points from 0; intervals are half open."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

# --- tokens -----------------------------------------------------------------------------------------------------------

#: Letters, digits, or a run of one symbol; white space completes the partition of the text. Fixed pattern.
TOKEN_PIECES = r"(?U)[^\W\d_]+|\d+|([^\w\s]|_)\1*|\s+"
WORD, NUMBER, PUNCTUATION = 0, 1, 2
#: Fixed values of the sentence rules.
SENTENCE_END = r"[.?!。！？।][\"'”’»)\]}]*$"
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.")
CLOSERS = ('"', "'", "”", "’", "»", ")", "]", "}")


def pieces(text: Column) -> Column:
    """The text cut into tokens and the white space between them; joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PIECES), 0)


def is_space(piece: Column) -> Column:
    return piece.rlike(r"^(?U)\s+$")


def token_kind(piece: Column) -> Column:
    return F.when(piece.rlike(r"(?U)^\d+$"), NUMBER).when(piece.rlike(r"(?U)^[^\W_]+$"), WORD).otherwise(PUNCTUATION)


def tokens(text: Column) -> Column:
    """The tokens' strings alone."""
    return F.filter(pieces(text), lambda p: ~is_space(p))


def lower_tokens(text: Column) -> Column:
    return F.transform(tokens(text), F.lower)


def stem(token: Column) -> Column:
    """Lower case, without a plural s."""
    low = F.lower(token)
    return F.when((F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def ends_sentence(piece: Column, before: Column) -> Column:
    """Does a punctuation token end a sentence? before: the token before it, or null."""
    return piece.rlike(SENTENCE_END) & ~F.coalesce(F.concat(before, piece).isin(*ABBREVIATIONS), F.lit(False))


def starts_line_sentence(piece: Column, after_newline: Column) -> Column:
    """Does a token that follows a line break begin a sentence? Yes unless it starts with a small letter."""
    return after_newline & ~piece.rlike(r"^\p{Ll}")


# --- slices and intervals -----------------------------------------------------------------------------------------------


def span(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]"""
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def span_length(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start)


def sanitize(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, most: int = 120) -> Column:
    flat = sanitize(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


#: Fixed values.
CONTEXT_SIZES = {"small": 100, "medium": 200, "large": 300}


def context_size(level: Column) -> Column:
    """Characters of a context level; an unknown level is an error."""
    out = F.raise_error(F.concat(F.lit("unknown context level: "), F.coalesce(level, F.lit("null")))).cast("int")
    for name, size in CONTEXT_SIZES.items():
        out = F.when(level == name, size).otherwise(out)
    return out


def neighbour_text(text: Column, start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """Up to `size` characters before and after a span."""
    first = F.greatest(start - size, F.lit(0))
    return span(text, first, start), span(text, end, end + size)


# --- lines ----------------------------------------------------------------------------------------------------------------

#: All line ends that a text is split at, with the line before each. Fixed pattern.
LINES = r"[^\n\r\x0B\x0C\x1C-\x1E\x85  ]*(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ])|[^\n\r\x0B\x0C\x1C-\x1E\x85  ]+"
#: Fixed patterns of the Markdown line kinds.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
FENCE = r"^\s*(```+|~~~+)"
CHECKLIST = r"^(\s*)[-*+]\s+\[(?: |x|X)\]\s+"
NUMBERED = r"^(\s*)\d+[.)]\s+"
BULLET = r"^(\s*)[-*+]\s+"
QUOTE = r"^\s*>\s?"


def lines(text: Column) -> Column:
    """Lines with their ends."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINES), 0)


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def line_kind(line: Column) -> Column:
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    return (
        F.when(bare.rlike(r"^(?U)\s*$"), "blank")
        .when(bare.rlike(HEADING), "heading")
        .when(bare.rlike(FENCE), "code_fence")
        .when((pipes(bare) >= 2) & ~bare.rlike(QUOTE), "table")
        .when(line.rlike(CHECKLIST), "checklist_item")
        .when(line.rlike(NUMBERED), "numbered_item")
        .when(line.rlike(BULLET), "bullet_item")
        .when(bare.rlike(QUOTE), "blockquote")
        .otherwise("paragraph")
    )


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))


# --- residual block predicates ------------------------------------------------------------------------------------------

#: Fixed patterns of the residual cleaning.
EMPTY_MARKS = r"^[\s\-\[\]()#>*_`~|:;,.!?/\\]+$"
WRAPPERS = r"[\s\[\]()<>{}'\"`*_#.,;:!?-]+"
URL = r"^(?:https?://\S+|www\.\S+)$"
TOC_LINK = r"\[[^\]]+\]\(#.+?\)"
LEADING_HEADING = r"^(\s*#{1,6}\s+[^\n]+(?:\n+|$))"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def left_space(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"^(?U)(\s*)", 1))


def right_space(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"(?U)(\s*)$", 1))


def is_empty_text(text: Column) -> Column:
    bare = strip(text)
    return (bare == "") | bare.rlike(EMPTY_MARKS)


def is_url_text(text: Column) -> Column:
    core = F.regexp_replace(F.regexp_replace(strip(text), "^" + WRAPPERS, ""), WRAPPERS + "$", "")
    return (core != "") & core.rlike(URL)


#: Fixed marks of a table of contents.
TOC_OPEN, TOC_CLOSE = "<!-- toc -->", "<!-- /toc -->"


def is_toc_text(text: Column) -> Column:
    return text.contains(TOC_OPEN) | text.contains(TOC_CLOSE) | (F.size(F.regexp_extract_all(text, F.lit(TOC_LINK), 0)) >= 2)


def leading_heading(text: Column) -> Column:
    """The heading at the text's beginning with the line ends after it; empty if there is none."""
    return F.regexp_extract(text, LEADING_HEADING, 1)


def is_heading_text(text: Column) -> Column:
    head = leading_heading(text)
    return (head != "") & (strip(F.substring(text, F.length(head) + 1, F.length(text))) == "")


# --- evaluation text ------------------------------------------------------------------------------------------------------

#: Fixed pattern of the evaluation's tokens.
EVAL_TOKENS = r"[A-Za-z0-9_.:/-]+|[^\s]"
#: Fixed values of the alignment status.
STATUSES = ("match_exact", "match_lesser", "match_fuzzy", "match_none")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def normal_text(text: Column, compatibility: bool = True) -> Column:
    """Compatibility form, plain quotes, single spaces, lower case. Without compatibility forms it stays in the JVM."""
    whole = F.coalesce(text, F.lit(""))
    whole = nfkc(whole) if compatibility else whole
    return F.lower(sanitize(F.regexp_replace(whole, r'\\+"', '"')))


def eval_tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(EVAL_TOKENS), 0)


#: Rows whose tokens are counted at once.
COUNTED_ROWS = 1000


def _bag_overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
    """bag_overlap of some rows: each (row, token) of both sides is one number, and the numbers are counted."""
    texts, rows = pa.concat_arrays([a.flatten(), b.flatten()]), np.concatenate([np.asarray(pc.list_parent_indices(x)) for x in (a, b)])
    coded = texts.dictionary_encode()
    there, first = np.asarray(texts.is_valid()), np.arange(len(texts)) < len(a.flatten())
    size = max(len(coded.dictionary), 1)
    keys = rows * size + np.asarray(coded.indices.fill_null(0)).astype(np.int64)
    (x, n), (y, m) = (np.unique(keys[there & own], return_counts=True) for own in (first, ~first))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.bincount(both // size, weights=np.minimum(n[i], m[j]), minlength=len(a)).astype(np.int32)
    return pa.array(shared, mask=~np.asarray(pc.and_(a.is_valid(), b.is_valid())))


@F.arrow_udf(IntegerType())
def bag_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many elements two bags share. Nulls inside are none."""
    parts = [_bag_overlaps(a.slice(k, COUNTED_ROWS), b.slice(k, COUNTED_ROWS)) for k in range(0, len(a), COUNTED_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.int32())


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _longest_run(x: list[str], y: list[str]) -> int:
    """The longest run of tokens that both lists have."""
    code: dict[str, int] = {}
    p, q = (np.array([code.setdefault(t, len(code)) for t in z], dtype=np.int64) for z in (x, y))
    best, row = 0, np.zeros(len(q) + 1, dtype=np.int32)
    for one in p:
        new = np.zeros_like(row)
        new[1:] = np.where(q == one, row[:-1] + 1, 0)
        best, row = max(best, int(new.max())), new
    return best


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("precision", "recall", "f1", "lccs")]))
def overlap_stats(pred: pd.Series, label: pd.Series) -> pd.DataFrame:
    """precision, recall and F1 of the shared tokens of two normal texts, and their longest run over the shorter one."""
    split, rows = re.compile(EVAL_TOKENS).findall, []
    for x, y in zip(pred, label, strict=True):
        a, b = split(x or ""), split(y or "")
        both = (Counter(a) & Counter(b)).total()
        p, r = both / len(a) if a else 0.0, both / len(b) if b else 0.0
        rows.append((p, r, 2 * p * r / (p + r) if p + r else 0.0, _longest_run(a, b) / min(len(a), len(b)) if both else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1", "lccs"])


def relaxed_weight(x: str, y: str, a: list[str], b: list[str], in_a: Counter, in_b: Counter, f1: float, precision: float, recall: float, lccs: float) -> float | None:
    """relaxed_match of one pair: x and y the texts, a and b their tokens, in_a and in_b these counted."""
    both = sum(min(in_a[t], in_b[t]) for t in in_a.keys() & in_b.keys())
    if not both:
        return None
    p, r = both / len(a), both / len(b)
    f = 2 * p * r / (p + r)
    near = (x in y and r > recall) or (y in x and p > precision)
    near = near or (f > f1 and (a == b or _longest_run(a, b) / min(len(a), len(b)) > lccs))
    return f if near else None


def relaxed_match(pred: Column, label: Column, f1: float, precision: float, recall: float, lccs: float) -> Column:
    """The F1 of two normal texts if they match, else null: one holds the other and shares enough of its tokens, or both
    F1 and longest run are over their bounds. The run is only looked for where it decides."""
    split = re.compile(EVAL_TOKENS).findall

    @F.arrow_udf(DoubleType())
    def matched(preds: pa.Array, labels: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(preds.to_pylist(), labels.to_pylist(), strict=True):
            a, b = split(x or ""), split(y or "")
            out.append(relaxed_weight(x, y, a, b, Counter(a), Counter(b), f1, precision, recall, lccs))
        return pa.array(out, type=pa.float64())

    return matched(pred, label)


def status_name(status: Column) -> Column:
    low = F.lower(F.trim(status))
    return F.when(low.isin(*STATUSES), low).otherwise("match_none")


def _normal(value: object) -> object:
    """A value of JSON with all its texts in normal form."""
    if isinstance(value, str):
        return re.sub(r"\s+", " ", re.sub(r'\\+"', '"', unicodedata.normalize("NFKC", value))).strip().lower()
    if isinstance(value, list):
        return [_normal(x) for x in value]
    return {str(k): _normal(v) for k, v in value.items()} if isinstance(value, dict) else value


def _normal_json(value: str | None) -> str | None:
    """As _normal, for text that may be the JSON of a list or an object."""
    if value is None:
        return None
    if value.lstrip()[:1] in ("[", "{"):
        try:
            return json.dumps(_normal(json.loads(value)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            pass
    return _normal(value)


@F.arrow_udf(MapType(StringType(), StringType()))
def _normal_values(maps: pa.Array) -> pa.Array:
    rows = [None if m is None else [(k, _normal_json(v)) for k, v in m] for m in maps.to_pylist()]
    return pa.array(rows, type=pa.map_(pa.string(), pa.string()))


def normal_attributes(attributes: Column, compatibility: bool = True) -> Column:
    """Attributes with normal values, those of lists and objects inside too. Null is empty. Without compatibility forms it
    stays in the JVM and takes a list's JSON as one text."""
    whole = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    if compatibility:
        return _normal_values(whole)
    return F.transform_values(whole, lambda _, v: F.when(v.isNotNull(), normal_text(v, False)))


def normal_attributes_within(a: Column, b: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Has b every key of a that isn't ignored, with an equal value? For normal attributes; not symmetric."""
    keys = F.map_keys(a) if not ignored else F.filter(F.map_keys(a), lambda k: ~k.isin(*ignored))
    return F.forall(keys, lambda k: F.map_contains_key(b, k) & F.element_at(a, k).eqNullSafe(F.element_at(b, k)))


def attributes_within(a: Column, b: Column) -> Column:
    """Has b every key of a with an equal normal value? Both map<string,string>; null is empty. Not symmetric."""
    return normal_attributes_within(normal_attributes(a, False), normal_attributes(b, False))


def shown_attributes(attributes: Column) -> Column:
    """Attributes without those that are null, empty or the word null."""
    return F.map_filter(attributes, lambda _, v: v.isNotNull() & ~v.isin("", "null"))


# --- keys -----------------------------------------------------------------------------------------------------------------


def signal_id(doc: Column, block: Column, conclusion: Column) -> Column:
    return F.concat(F.lit("sig_"), F.substring(F.sha1(F.concat_ws(":", doc, block, conclusion)), 1, 16))


def cache_key(**parts: Column) -> Column:
    """One hash of named parts in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def is_url(text: Column) -> Column:
    """http or https with a host, nothing else before or after."""
    bare = strip(text)
    return F.coalesce((bare == text) & text.rlike(r"^https?://([A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*|localhost)(:\d{1,5})?(/\S*)?(\?\S*)?(#\S*)?$"), F.lit(False))


def doc_id_of(stem_name: Column) -> Column:
    """The document of a label or prediction file's stem."""
    return F.regexp_replace(F.regexp_replace(stem_name, "^pred_", ""), "_v1$", "")
