"""Model output: strings that look like lists, YAML, suppressed errors, and the size of the plan."""

import json

import pytest

from spanloom import catalog
from spanloom.functions import parsing as P
from spanloom.operators import inference as N
from spanloom.plans import extraction


def flat(spark, output, **options):
    rows = P.parse_outputs(spark.createDataFrame([(1, output)], "k int, output string"), **options)
    return [(r["class"], r["text"], r["attributes"]) for r in P.flatten(rows, ["k"]).orderBy("extraction_index").collect()]


def test_strings_that_look_like_lists(spark):
    assert flat(spark, '{"extractions":[{"a":"[1] ref","b":" {x}","c":1.0,"d":true,"e":"null"}]}') == [("a", "[1] ref", None), ("b", " {x}", None), ("c", "1.0", None), ("d", "True", None), ("e", "null", None)]


def test_values_that_are_no_text(spark):
    for value, what in (("[1]", "string or number: a"), ("{}", "string or number: a"), ("null", "string or number: a")):
        with pytest.raises(Exception, match=what):
            flat(spark, f'{{"extractions":[{{"a":{value}}}]}}')
    with pytest.raises(Exception, match="attributes must be an object: a_attributes"):
        flat(spark, '{"extractions":[{"a":"x","a_attributes":[1]}]}')
    assert flat(spark, '{"extractions":[{"a":"x","a_attributes":null,"b":"y","b_attributes":{"k":["p","q"],"m":null}}]}') == [("a", "x", None), ("b", "y", {"k": '["p","q"]', "m": None})]


def test_indexes_must_be_integers(spark):
    rows = P.parse_outputs(spark.createDataFrame([(1, '{"extractions":[{"a":"x","a_index":"2"}]}')], "k int, output string"))
    with pytest.raises(Exception, match="index must be an integer: a_index"):
        P.flatten(rows, ["k"], "_index").collect()


def test_yaml(spark):
    assert flat(spark, "```yaml\nextractions:\n- a: x\n  a_attributes:\n    k: v\n- b: 7\n```", tag="yaml") == [("a", "x", {"k": "v"}), ("b", "7", None)]
    errors = P.parse_outputs(spark.createDataFrame([(1, "a: [1"), (2, "- 1: x"), (3, "<think>a: [</think>\n- a: x")], "k int, output string"), tag="yaml")
    assert {r["k"]: r["parse_error"] for r in errors.collect()} == {1: "not YAML", 2: "a key is not a string", 3: None}


def test_strict_fences(spark):
    assert flat(spark, 'x\n```json\n{"extractions":[{"a":"x"}]}\n```', strict=True) == [("a", "x", None)]
    errors = P.parse_outputs(spark.createDataFrame([(1, '{"extractions":[]}'), (2, "```json\n[]\n```")], "k int, output string"), strict=True)
    assert {r["k"]: r["parse_error"] for r in errors.collect()} == {1: "expected exactly one fence", 2: "no extractions list"}
    assert [P.load(x) for x in ("```\n[1]\n```", '```json\n{"a":1}\n```')] == [[1], {"a": 1}]


def test_odd_characters_and_depth(spark):
    rows = P.parse_outputs(spark.createDataFrame([(1, '[{"a":"\\ud800x"}]'), (2, "[" * 100000)], "k int, output string"))
    assert {r["k"]: r["parse_error"] for r in rows.collect()} == {1: None, 2: "not JSON"}


def test_suppressed_errors_of_values(spark):
    class Bad:
        def infer(self, prompts):
            return ['{"extractions":[{"a":[1]}]}' if "bad" in p.split("Q:")[-1] else '{"extractions":[{"a":"good"}]}' for p in prompts]

    docs = spark.createDataFrame([(1, "bad words"), (2, "good words")], "doc_id int, text string")
    template = N.Template("List.", (N.Example("Call 12 now.", (("number", "12", {}),)),))
    kept = extraction.extract(docs, template, Bad(), extraction.ExtractConfig(suppress_parse_errors=True)).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(2, "good")]
    with pytest.raises(Exception, match="string or number"):
        extraction.extract(docs, template, Bad(), extraction.ExtractConfig()).collect()


def test_an_output_is_read_once(spark):
    plan = catalog.QUERIES["flatten_extractions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and plan.count("parsed(") == 1 and plan.count("from_json") + plan.count("regexp_") <= 2


def test_agent_answers_may_be_fenced():
    assert P.load("```json\n" + json.dumps({"conclusions": []}) + "\n```") == {"conclusions": []}
