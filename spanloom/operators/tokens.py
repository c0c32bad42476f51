"""Token and sentence rows. Relational forms stay in the JVM; `scan` is the document-local form for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.intervals import CELL


def token_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, sentences: bool = False) -> DataFrame:
    """(id, idx, token, kind, start, end, nl) for each token; nl: a line break stands before it (never the first).
    sentences: with the sentence number of sentence_rows.

    Each document is cut where it lies, by arrays over many texts at a time; classes of characters are the JVM's."""
    table = docs.sparkSession.sparkContext.broadcast(_classes(docs.sparkSession))
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["idx", "token", "kind", "start", "end", "nl", *(["sentence"] if sentences else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _small(batches):
            cut = cut_tokens(texts, table.value)
            if sentences:
                cut["sentence"] = _sentences(cut)
            whole = pa.table([ids.take(pa.array(cut["doc"])), *(cut[n] if n == "token" else pa.array(cut[n]) for n in names)], names=["id", *names])
            yield from whole.to_batches(max_chunksize=50_000)

    schema = f"id {kind}, idx int, token string, kind int, start int, end int, nl boolean" + (", sentence int" if sentences else "")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_column)


#: Classes of characters: letters and marks, digits, white space, others. _LOWER marks small letters.
_LETTER, _DIGIT, _SPACE, _SYMBOL, _LOWER = 0, 1, 2, 3, 4


def _classes(spark: SparkSession) -> np.ndarray:
    """The class of each code point by the JVM's patterns, which T.pieces cuts by."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    text, out = F.col("x"), np.full(0x110000, _SYMBOL, dtype=np.uint8)
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\d", "0"), r"(?U)[^\W\d_]", "a"), r"(?U)\s", " ")
    kinds, small = spark.createDataFrame([(every,)], "x string").select(marked, F.regexp_replace(text, r"\p{Ll}", "\n")).collect()[0]
    codes = lambda x: np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
    at, kinds = codes(every), codes(kinds)
    for kind, sign in ((_LETTER, "a"), (_DIGIT, "0"), (_SPACE, " ")):
        out[at[kinds == ord(sign)]] = kind
    out[at[(codes(small) == 10) & (at != 10)]] |= _LOWER
    return out


def _small(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in parts of about `most` bytes."""
    for batch in batches:
        begin, size, texts = 0, 0, []
        for k, text in enumerate(batch.column("text")):
            raw = text.as_py() or b""
            texts.append(raw.decode("utf-8", "replace"))
            size += len(raw)
            if size >= most or k + 1 == batch.num_rows:
                yield batch.column("id").slice(begin, k + 1 - begin), texts
                begin, size, texts = k + 1, 0, []


def cut_tokens(texts: list[str], classes: np.ndarray) -> dict:
    """The tokens of all texts as arrays: doc (place of the text), idx, token, kind, start, end, nl, small (does it begin
    with a small letter), sign (the code point of a run of symbols, else 0)."""
    whole = "".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    begins = np.cumsum([0, *map(len, texts)])
    of = classes[code]
    kind = of & 3
    new = np.ones(len(code), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _SYMBOL) & (code[1:] != code[:-1]))
    new[begins[:-1][begins[:-1] < len(code)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(code))[: len(start)]
    width = np.concatenate([[0], np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))])
    pieces = pa.StringArray.from_buffers(len(start), pa.py_buffer(width[np.append(start, len(code))].astype(np.int32)), pa.py_buffer(whole.encode()))
    breaks = np.concatenate([[0], np.cumsum((code == 10) | (code == 13))])
    doc = np.searchsorted(begins, start, side="right") - 1
    space = kind[start] == _SPACE
    broken = np.zeros(len(start), dtype=bool)
    broken[1:] = (space & (breaks[end] > breaks[start]))[:-1] & (doc[1:] == doc[:-1])
    real = ~space
    token, doc, start, end, nl = pieces.filter(pa.array(real)), doc[real], start[real], end[real], broken[real]
    idx = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
    sort, place = kind[start], begins[doc]
    named = np.array([T.WORD, T.NUMBER, -1, T.PUNCTUATION], dtype=np.int32)[sort]
    int32 = lambda x: x.astype(np.int32)
    return {"doc": doc, "idx": int32(idx), "token": token, "kind": named, "start": int32(start - place), "end": int32(end - place), "nl": nl & (idx > 0), "small": of[start] >= _LOWER, "sign": np.where(sort == _SYMBOL, code[start], 0)}


#: Symbols that end a sentence; a token is a run of one symbol.
_STOPS, _CLOSERS = (np.array([ord(c) for c in x], dtype=np.uint32) for x in (".?!。！？।", T.CLOSERS))


def _sentences(cut: dict) -> np.ndarray:
    """The sentence number of each token of cut_tokens, as sentence_rows has it."""
    doc, n = cut["doc"], len(cut["doc"])
    same = np.zeros(n, dtype=bool)  # is the next token of the same text?
    same[:-1] = doc[1:] == doc[:-1]
    after = lambda x: np.append(x[1:], False)[:n] & same
    short = np.asarray(pc.is_in(cut["token"], value_set=pa.array([a[:-1] for a in T.ABBREVIATIONS])).to_numpy(zero_copy_only=False))
    one = cut["end"] - cut["start"] == 1
    abbreviated = np.zeros(n, dtype=bool)
    abbreviated[1:] = (short & same)[:-1] & one[1:] & (cut["sign"][1:] == ord("."))
    ends = np.isin(cut["sign"], _STOPS) & ~abbreviated
    closes = one & np.isin(cut["sign"], _CLOSERS) & ~ends
    last = np.maximum.accumulate(np.where(closes, -1, np.arange(n)))
    drawn = closes & (last >= 0) & ends[last] & (doc[last] == doc)
    stops = (ends | drawn | after(cut["nl"] & ~cut["small"])) & ~after(drawn)
    before = np.cumsum(stops) - stops
    return (before - before[np.searchsorted(doc, doc, side="left")]).astype(np.int32)


def sentence_rows(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """tokens with a sentence number from 0. Closing marks after an end belong to the sentence that ends."""
    by = Window.partitionBy(id_column).orderBy("idx")
    t, punct = F.col("token"), F.col("kind") == T.PUNCTUATION
    rows = tokens.withColumn("_end", punct & T.ends_sentence(t, F.lag("token").over(by))).withColumn("_close", punct & t.isin(*T.CLOSERS) & ~F.col("_end"))
    # a closing mark is drawn in when the last token before the run of closing marks ends a sentence
    rows = rows.withColumn("_drawn", F.col("_close") & F.coalesce(F.last(F.when(~F.col("_close"), F.col("_end")), ignorenulls=True).over(by), F.lit(False)))
    line = F.lead(T.starts_line_sentence(t, F.col("nl"))).over(by)
    stop = (F.col("_end") | F.col("_drawn") | F.coalesce(line, F.lit(False))) & ~F.coalesce(F.lead("_drawn").over(by), F.lit(False))
    rows = rows.withColumn("_stop", stop.cast("int"))
    return rows.withColumn("sentence", F.coalesce(F.sum("_stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).drop("_end", "_close", "_drawn", "_stop")


def spans_to_tokens(spans: DataFrame, tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """spans (id, span_id, start, end) with the smallest token range [first, last) that touches each. Spans and tokens meet
    in cells of the text, so a long text is no quadratic group."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / CELL)))
    named = spans.withColumnsRenamed({"start": "from", "end": "to"}).withColumn("_cell", cells("from", "to"))
    hit = named.join(tokens.withColumn("_cell", cells("start", "end")), [id_column, "_cell"]).where((F.col("start") < F.col("to")) & (F.col("from") < F.col("end")))
    return hit.groupBy(id_column, "span_id", "from", "to").agg(F.min("idx").alias("first_token"), (F.max("idx") + 1).alias("end_token")).withColumnsRenamed({"from": "start", "to": "end"})


def spans_to_text_tokens(spans: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """spans_to_tokens over the tokens of docs, without a row for each token: spans meet whole texts in lists."""
    table = docs.sparkSession.sparkContext.broadcast(_classes(docs.sparkSession))
    kinds = {c: spans.schema[c].dataType.simpleString() for c in (id_column, "span_id", "start", "end")}
    listed = spans.where("start IS NOT NULL AND end IS NOT NULL").groupBy(id_column).agg(F.collect_set(F.struct("span_id", "start", "end")).alias("_s"))
    joined = docs.select(F.col(id_column), F.col(text_column).cast("binary").alias("text")).join(listed, id_column).withColumnRenamed(id_column, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in _small(iter([batch])):
                cut = cut_tokens(texts, table.value)
                lists = batch.column("_s").slice(at, len(ids))
                at += len(ids)
                flat, doc = lists.flatten(), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
                span, a, b = flat.flatten()
                far = int(max([0, *map(len, texts)])) + 2
                reach = lambda x: np.clip(np.asarray(x).astype(np.int64), -1, far - 1)
                key = lambda d, x: d * (far + 1) + x + 1
                begin = np.searchsorted(cut["doc"], doc, side="left")
                first = np.searchsorted(key(cut["doc"], cut["end"]), key(doc, reach(a)), side="right") - begin
                last = np.searchsorted(key(cut["doc"], cut["start"]), key(doc, reach(b)), side="left") - begin
                found = pa.array(first < last)
                int32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([c.filter(found) for c in (ids.take(pa.array(doc)), span, a, b, int32(first), int32(last))], names=["id", "span_id", "start", "end", "first_token", "end_token"])

    rows = joined.mapInArrow(run, f"id {kinds[id_column]}, span_id {kinds['span_id']}, start {kinds['start']}, end {kinds['end']}, first_token int, end_token int")
    return rows.withColumnRenamed("id", id_column)


# --- document-local form ------------------------------------------------------------------------------------------------

_TOKEN = regex.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*")
_DIGITS, _WORDS = regex.compile(r"\d+"), regex.compile(r"[^\W_]+")
_END, _BREAK = regex.compile(T.SENTENCE_END), regex.compile(r"[\n\r]+")


@dataclass
class Tokens:
    """Tokens of one text as arrays."""

    text: str
    start: np.ndarray
    end: np.ndarray
    nl: np.ndarray
    word: list[str]

    def __len__(self) -> int:
        return len(self.word)

    def stops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: does it end a sentence, does a new line's sentence follow it, is it a closing mark?"""
        n = len(self)
        ends, follows, closing = (np.zeros(n, dtype=bool) for _ in range(3))
        for k, w in enumerate(self.word):
            if not w[0].isalnum():
                ends[k] = bool(_END.search(w)) and not (k and self.word[k - 1] + w in T.ABBREVIATIONS)
                closing[k] = w in T.CLOSERS
        for k in np.flatnonzero(self.nl).tolist():  # never the first
            follows[k - 1] = not self.word[k][0].islower()
        return ends, follows, closing


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each token by the pattern."""
    return [m.span() for m in _TOKEN.finditer(text)]


def scan(text: str, unicode_graphemes: bool = False) -> Tokens:
    """The tokens of a text by the pattern, or by grapheme clusters and scripts."""
    spans = list(_graphemes(text)) if unicode_graphemes else token_spans(text)
    place = np.array(spans, dtype=np.int64).reshape(-1, 2)
    start, end = np.ascontiguousarray(place[:, 0]), np.ascontiguousarray(place[:, 1])
    nl = np.zeros(len(spans), dtype=bool)
    if len(spans) > 1 and (breaks := [m.start() for m in _BREAK.finditer(text)]):
        after = np.searchsorted(start, np.array(breaks), side="right")  # breaks are white space, so each is in a gap
        nl[after[(after > 0) & (after < len(spans))]] = True
    return Tokens(text, start, end, nl, [text[a:b] for a, b in spans])


#: Scripts whose words are told apart, and scripts written without spaces. Fixed values.
_ALPHABETS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari")
_ALONE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SCRIPT = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in _ALPHABETS]


def _graphemes(text: str):
    """Spans of tokens by grapheme clusters. Clusters of one kind join: words of one known script, digits, equal marks;
    scripts without spaces stay one cluster each."""
    held = None  # start, end, kind, script, cluster
    for m in regex.finditer(r"\X", text):
        cluster = m.group()
        if cluster.isspace():
            if held:
                yield held[:2]
            held = None
            continue
        kind = "number" if cluster[0].isdigit() else "word" if regex.match(r"\p{L}|\p{M}", cluster[0]) else "mark"
        script = None
        if kind == "word":
            script = "alone" if _ALONE.match(cluster[0]) else next((n for n, p in _SCRIPT if p.match(cluster[0])), None)
        joins = held is not None and held[2] == kind and (kind == "number" or (kind == "word" and script == held[3] and script not in (None, "alone")) or (kind == "mark" and text[held[0] : m.start()].endswith(cluster)))
        if joins:
            held = (held[0], m.end(), kind, script)
        else:
            if held:
                yield held[:2]
            held = (m.start(), m.end(), kind, script)
    if held:
        yield held[:2]
