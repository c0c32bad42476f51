import hashlib
import math
import re
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import parsing as P
from spanloom.functions import text as T
from spanloom.operators import chunks as C
from spanloom.operators import tokens as K

TEXTS = [
    "Mr. Fox said “Go!” Then he left.) ok", "a1b2 c_d!! --- ??", "Line one\nline two\nLine three\r\n\"quoted\" end", "", "  \n ", "Grüße ﬁn 日本語。次 ½ x²", "No. 5\n\nNext: 1) a 2) b",
    "He left.”) And (so.) [on.] ok?! yes", "Dr. Who met Mrs. Poe.\n42 came. and more", "tab\tsep\x0bvt\x0cff\x1cfs\x85nel line para", "é combining 👩‍👩‍👧 zwj",
]


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'int'}" for n in names)).select(column.alias("x")).first()["x"]


def plain_tokens(text):
    return [m.span() for m in regex.finditer(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*", text)]


def plain_sentences(text):
    """Sentence ends by a walk over the tokens."""
    spans = plain_tokens(text)
    words = [text[a:b] for a, b in spans]
    gap = [regex.search(r"[\n\r]", text[spans[k - 1][1] : spans[k][0]]) is not None if k else False for k in range(len(spans))]
    out, at, k = [], 0, 0
    while k < len(words):
        mark = not regex.fullmatch(r"[^\W_]+", words[k])
        if mark and regex.search(T.SENTENCE_END, words[k]) and not (k and words[k - 1] + words[k] in T.ABBREVIATIONS):
            k += 1
            while k < len(words) and words[k] in T.CLOSERS:
                k += 1
        elif k + 1 < len(words) and gap[k + 1] and not words[k + 1][0].islower():
            k += 1
        else:
            k += 1
            continue
        out.append((at, k))
        at = k
    return out + ([(at, len(words))] if at < len(words) else [])


def test_tokens_and_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = K.sentence_rows(K.token_rows(docs)).collect()
    for k, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["idx"])
        assert [(r["start"], r["end"]) for r in own] == plain_tokens(text)
        local = K.scan(text)
        assert [(r["token"], r["nl"]) for r in own] == list(zip(local.word, local.nl.tolist(), strict=True))
        assert all((r["kind"] == T.NUMBER) == bool(regex.fullmatch(r"\d+", r["token"])) for r in own)
        expected = [s for s, (a, b) in enumerate(plain_sentences(text)) for _ in range(a, b)]
        assert [r["sentence"] for r in own] == expected, text


def test_spans_to_tokens(spark):
    docs = spark.createDataFrame([(1, "one two, three")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 5, 8), (1, 1, 4, 7), (1, 2, 3, 4)], "doc_id int, span_id int, start int, end int")
    found = {r["span_id"]: (r["first_token"], r["end_token"]) for r in K.spans_to_tokens(spans, K.token_rows(docs)).collect()}
    assert found == {0: (1, 3), 1: (1, 2)}


def test_grapheme_tokens():
    words = lambda t: K.scan(t, True).word
    assert words("Hello world!! 12") == ["Hello", "world", "!!", "12"]
    assert words("日本 abcд éf") == ["日", "本", "abc", "д", "éf"]
    assert words("?!x") == ["?", "!", "x"] and K.scan("a\nb", True).nl.tolist() == [False, True]


def chunk_texts(text, limit):
    t = K.scan(text)
    return [text[t.start[a] : t.end[b - 1]] for a, b in C.sentence_chunks(t, limit)]


def test_documented_chunks():
    assert chunk_texts("No man is an island,\nEntire of itself,\nEvery man is a piece of the continent,\nA part of the main.", 40) == ["No man is an island,\nEntire of itself,", "Every man is a piece of the continent,", "A part of the main."]
    assert chunk_texts("This is antidisestablishmentarianism.", 20) == ["This is", "antidisestablishmentarianism", "."]
    assert chunk_texts("Roses are red. Violets are blue. Flowers are nice. And so are you.", 60) == ["Roses are red. Violets are blue. Flowers are nice.", "And so are you."]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", "longerword", ".", "!", '"', "\n", " ", "12", "Mr", "?\n", ")"]), max_size=60).map("".join), st.integers(1, 40))
def test_chunks_partition_the_tokens(text, limit):
    tokens = K.scan(text)
    found = C.sentence_chunks(tokens, limit)
    assert [k for a, b in found for k in range(a, b)] == list(range(len(tokens)))
    assert all(b - a == 1 or tokens.end[b - 1] - tokens.start[a] <= limit for a, b in found)


def test_batches_and_previous(spark):
    rows = [(d, k, f"text {d} {k}") for d in range(40) for k in range(d % 4)]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk int, chunk_text string")
    found = {(r["doc_id"], r["chunk"]): r["batch"] for r in C.batches(chunks, 7).collect()}
    assert found == {(d, k): i // 7 for i, (d, k, _) in enumerate(sorted(rows))}
    before = {(r["doc_id"], r["chunk"]): r["previous"] for r in C.with_previous(chunks, 3).collect()}
    assert before[(3, 0)] is None and before[(3, 1)] == "3 0"


MARKDOWN = """# Title

## Table of Contents
- [One](#one)
- [Two](#two)

## One
Text of one
goes on.
> quote
- item a
  more of a
  - item b
1. first
- [ ] todo

### Deeper?
~~~
# no heading
~~~
| a | b |
|---|---|
Last.
## Two
end
"""


def test_markdown(spark):
    tokens = K.scan(MARKDOWN)
    found = C.blocks(MARKDOWN, tokens)
    kinds = [b.kind for b in found]
    assert kinds == ["heading", "heading", "bullet_item", "bullet_item", "heading", "paragraph", "blockquote", "bullet_item", "bullet_item", "numbered_item", "checklist_item", "heading", "code_fence", "table", "paragraph", "heading", "paragraph"]
    assert found[7].raw == "- item a\n  more of a\n" and found[8].indent == 2 and found[12].path == [0, 4, 11] and found[15].path == [0]
    assert C.toc_blocks(found) == {1, 2, 3}
    policy = C.ChunkPolicy(limit=60)
    kept = C.containers(found, policy)
    assert [(c.kind, c.members) for c in kept] == [("subtree", [4, 5, 6, 7, 8, 9]), ("qa", [11, 14]), ("subtree", [15, 16])]
    assert C.skip_reason(found[0], set(), policy) == "skip_document_title" and C.skip_reason(found[13], set(), policy) == "skip_table"
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None)], "doc_id int, text string")
    rows = C.structured_chunk_rows(docs, policy).orderBy("chunk").collect()
    assert {r["doc_id"] for r in rows} == {1} and rows[0]["decision"] == "fallback" and rows[-1]["decision"] == "merged"
    assert rows[-1]["context_text"].startswith("# Title") and all(MARKDOWN[r["start"] : r["end"]] == r["chunk_text"] for r in rows)
    lines = spark.createDataFrame([(MARKDOWN,)], "t string").select(F.explode(T.lines(F.col("t"))).alias("x")).select("x", T.line_kind(F.col("x")).alias("k")).collect()
    assert [r["x"] for r in lines] == MARKDOWN.splitlines(keepends=True) and [r["k"] for r in lines] == [C._kind(x) for x in MARKDOWN.splitlines(keepends=True)]


def test_lines_are_splitlines(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").select("k", T.lines(F.col("t")).alias("x")).collect()
    assert all(r["x"] == TEXTS[r["k"]].splitlines(keepends=True) for r in rows)


def test_scalar_functions(spark):
    t = F.col("t")
    assert one(spark, T.sanitize(t), t="  a \n\t b ") == "a b"
    assert one(spark, T.normal_text(t), t=' ﬁne \\"X\\"\n½ ') == 'fine "x" 1⁄2'
    assert [one(spark, T.stem(t), t=x) for x in ("Cats", "glass", "his", "bus", "ideas")] == ["cat", "glass", "his", "bus", "idea"]
    assert one(spark, T.span(t, F.lit(2), F.lit(4)), t="a\U0001f600cde") == "cd"
    assert [one(spark, T.status_name(t), t=x) for x in (" Match_Exact", "odd", None)] == ["match_exact", "match_none", "match_none"]
    assert one(spark, T.preview(t, 10), t="aaa  bbb ccc ddd") == "aaa bbb..."
    assert [one(spark, T.is_url(t), t=x) for x in ("https://a.b/c?d#e", "http://localhost:80", "ftp://a.b", "see http://a.b", None)] == [True, True, False, False, False]
    assert one(spark, T.doc_id_of(t), t="pred_doc_v1") == "doc"
    assert [one(spark, T.is_empty_text(t), t=x) for x in (" \n", "--- ...", "1.", "x")] == [True, True, False, False]
    assert [one(spark, T.is_url_text(t), t=x) for x in ("(https://a.b)", "- www.x.org.", "see https://a.b", "")] == [True, True, False, False]
    assert [one(spark, T.is_heading_text(t), t=x) for x in ("## A\n\n", "## A\nb", "a")] == [True, False, False]
    assert one(spark, T.context_size(t), t="large") == 300
    with pytest.raises(Exception, match="unknown context level"):
        one(spark, T.context_size(t), t="huge")
    assert one(spark, T.signal_id(t, F.lit("3"), F.lit("new_attr")), t="d") == "sig_" + hashlib.sha1(b"d:3:new_attr").hexdigest()[:16]
    assert one(spark, T.cache_key(b=t, a=F.lit(1)), t="x") == hashlib.sha256(b'{"a":1,"b":"x"}').hexdigest()


def test_attributes(spark):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>").select(T.attributes_within(F.col("a"), F.col("b"))).first()[0]
    assert pair({"k": " X "}, {"k": "x", "m": "1"}) and not pair({"k": "x", "m": "1"}, {"k": "x"}) and pair({}, {"k": "x"}) and pair(None, None) and not pair({"k": "y"}, {"k": "x"})
    shown = spark.createDataFrame([({"a": "", "b": "null", "c": None, "d": "1"},)], "a map<string,string>").select(T.shown_attributes(F.col("a"))).first()[0]
    assert shown == {"d": "1"}


def test_overlap(spark):
    pairs = [("a b c d", "b c d e"), ("x", ""), ("a a b", "a b b"), ("one two three", "one two three")]
    rows = spark.createDataFrame(pairs, "p string, q string").select("p", "q", T.overlap_stats(F.col("p"), F.col("q")).alias("s"), T.bag_overlap(F.split("p", " "), F.split("q", " ")).alias("n")).collect()
    found = {(r["p"], r["q"]): (round(r["s"]["precision"], 3), round(r["s"]["recall"], 3), round(r["s"]["f1"], 3), round(r["s"]["lccs"], 3), r["n"]) for r in rows}
    assert found[pairs[0]] == (0.75, 0.75, 0.75, 0.75, 3) and found[pairs[2]][3] == 0.667 and found[pairs[2]][4] == 2 and found[pairs[1]][:4] == (0, 0, 0, 0) and found[pairs[3]][:4] == (1, 1, 1, 1)


OUTPUTS = [
    ('{"extractions":[{"a":"x","a_attributes":{"k":"v"},"b":7}]}', None), ('```json\n{"extractions":[{"a":"x"}]}\n```', None), ('[{"a":"x"}]', None), ('<think>{"no</think>{"extractions":[]}', None),
    ("```\n[]\n```\n```\n[]\n```", "several fences"), ("", "empty output"), ("{oops", "not JSON"), ('{"other":[]}', "no extractions list"), ('{"extractions":[{"a":"x"},null]}', "an item is not an object"), ("```yaml\n[]\n```", None), (None, "empty output"),
]


def test_parsing(spark):
    rows = P.parse_outputs(spark.createDataFrame([(k, o) for k, (o, _) in enumerate(OUTPUTS)], "k int, output string"))
    assert {r["k"]: r["parse_error"] for r in rows.collect()} == {k: e for k, (_, e) in enumerate(OUTPUTS)}
    flat = P.flatten(rows.where("k = 0"), ["k"]).orderBy("extraction_index").collect()
    assert [(r["extraction_index"], r["class"], r["text"], r["attributes"]) for r in flat] == [(1, "a", "x", {"k": "v"}), (2, "b", "7", None)]
    indexed = P.flatten(P.parse_outputs(spark.createDataFrame([(1, '{"extractions":[{"a":"x","a_index":2,"b":"y","b_index":1,"c":"z"}]}')], "k int, output string")), ["k"], "_index")
    assert [(r["extraction_index"], r["text"]) for r in indexed.orderBy("extraction_index").collect()] == [(1, "y"), (2, "x")]
    with pytest.raises(Exception, match="must be a string or number"):
        P.flatten(P.parse_outputs(spark.createDataFrame([(1, '{"extractions":[{"a":[1]}]}')], "k int, output string")), ["k"]).collect()


def test_render_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, "a", 'say "x"\n', {"k": "v"}), (1, 1, "b", "y", None)], "doc int, ord int, class string, text string, attributes map<string,string>")
    back = P.flatten(P.parse_outputs(P.render(rows, ["doc"], "ord")), ["doc"]).orderBy("extraction_index").collect()
    assert [(r["class"], r["text"], r["attributes"]) for r in back] == [("a", 'say "x"\n', {"k": "v"}), ("b", "y", {})]
    schema = {(r["class"], r["attribute"]): r["is_list"] for r in P.response_schema(spark.createDataFrame([("a", {"k": "[1]"}), ("b", None)], "class string, attributes map<string,string>")).collect()}
    assert schema == {("a", "k"): True, ("b", None): False}
    made = P.json_schema([{"class": c, "attribute": k, "is_list": v} for (c, k), v in schema.items()])
    assert made["properties"]["extractions"]["items"]["properties"]["a_attributes"]["properties"]["k"]["type"] == "array"


def test_nfkc_matches_python(spark):
    assert one(spark, T.nfkc(F.col("t")), t="ﬃ①") == unicodedata.normalize("NFKC", "ﬃ①")
    assert re.fullmatch(T.SENTENCE_END.removesuffix("$"), "!") and math.isclose(1, 1)
