"""Policies of examples, tool calls, documents and reports."""

import json

import pytest

from spanloom.operators import inference as N
from spanloom.operators.align import AlignConfig
from spanloom.plans import evolution, extraction
from spanloom.sources import sinks


def test_example_levels(caplog):
    fine = N.Template("d", (N.Example("one two three", (("c", "two three", {}),)),))
    lesser = N.Template("d", (N.Example("one two three", (("c", "two three four", {}),)),))
    lost = N.Template("d", (N.Example("one two three", (("c", "zzz", {}),)),))
    guard = lambda t, level, **k: extraction.guard_examples(t, AlignConfig(), level, **k)
    assert guard(lost, "off") == [] and guard(fine, "error") == [] and len(guard(lost, "warning")) == 1 and "not found" in caplog.text
    assert len(guard(lesser, "error")) == 1
    with pytest.raises(extraction.ExampleError, match="1 example extractions"):
        guard(lost, "error")
    with pytest.raises(extraction.ExampleError):
        guard(lesser, "error", strict=True)
    with pytest.raises(ValueError, match="unknown level"):
        guard(fine, "loud")


def test_call_arguments():
    signals = [{"block_id": k, "doc_ref": d, "extraction_doc_ref": e, "text": f"t{k}", "tree": ["h"], "start": 0, "end": 2} for k, d, e in ((1, "a", "x"), (2, "a", None), (3, "b", "x"))]
    given = evolution.call_arguments(signals, [1, 2])
    assert given["doc_ref"] == "a" and given["extraction_doc_ref"] == "x" and [b["block_id"] for b in given["blocks"]] == [1, 2]
    with pytest.raises(ValueError, match="one doc_ref"):
        evolution.call_arguments(signals, [1, 3])
    with pytest.raises(ValueError, match="unknown blocks"):
        evolution.call_arguments(signals, [1, 9])


def test_triage_checks_arguments_and_reads_fences():
    asked = []

    class Model:
        turn = 0

        def infer(self, prompts):
            self.turn += 1
            call = {"name": "section_text", "block_ids": [1], "arguments": {"heading": "## A"} if self.turn == 2 else {"title": "x"}}
            answer = {"tools": [call]} if self.turn < 3 else {"conclusions": [{"block_id": 1, "conclusion": "noise", "reason": "r"}]}
            return ["```json\n" + json.dumps(answer) + "\n```"]

    state = evolution.triage({1: "t"}, Model(), {"section_text": lambda ids, given: asked.append(given) or dict.fromkeys(ids, "body")})
    assert state.evidence == {1: ["missing heading; unknown title", "body"]} and asked == [{"heading": "## A"}] and len(state.conclusions) == 1 and state.budget[1] == 1


def test_repeated_documents_are_an_error(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "doc_id int, text string")
    found = spark.createDataFrame([(1, 1, "c", "y", None, None), (1, 0, "c", "x", None, None)], "doc_id int, ord int, class string, text string, attributes map<string,string>, status string")
    rows = extraction.annotated(docs, found).collect()
    assert [(r["document_id"], r["text"], [e["extraction_text"] for e in r["extractions"]]) for r in rows] == [("1", "a", ["x", "y"]), ("2", "b", []), ("3", None, [])]
    with pytest.raises(Exception, match="repeated document id: 2"):
        extraction.annotated(docs.unionByName(docs.where("doc_id = 2")), found).collect()


def test_reports_end_with_next_steps():
    row = lambda m, f: {"metric": m, "precision": f, "recall": f, "f1": f, "tp": 1, "fp": 1, "fn": 1}
    rate = lambda m, v: {"metric": m, "value": v, "numerator": 1, "denominator": 9}
    summary = {"micro": [row("structured_strict", 0.4), row("structured_relaxed", 0.5)], "macro_doc": [], "macro_class": [], "diagnostics": [rate("structure_anomaly_rate", 0.05), rate("grounding_match_exact_rate", 0.7)], "errors": [{"bucket": "miss", "n": 3}, {"bucket": "spurious", "n": 0}]}
    text = sinks.summary_markdown(summary)
    good, bad = text.split("### Strengths")[1].split("### Key Risks")
    assert good.count("\n- ") == 3 and bad.split("### Next steps")[0].count("\n- ") == 1 and "kind miss" in bad and "examples of miss" in bad
    worse = summary | {"micro": [row("structured_strict", 0.39), row("structured_relaxed", 0.49)], "diagnostics": [rate("structure_anomaly_rate", 0.11)], "errors": []}
    text = sinks.summary_markdown(worse)
    assert "none by the bounds" in text.split("### Strengths")[1].split("### Key Risks")[0] and text.split("### Key Risks")[1].split("### Next steps")[0].count("\n- ") == 2
    verdict = {"overall_assessment": "a", "core_metric_assessment": "b", "improved_metric_count": 1, "degraded_metric_count": 0, "unchanged_metric_count": 0}
    delta = {"metric": "structured_relaxed", "baseline_f1": 0.1, "candidate_f1": 0.2, "f1_delta": 0.1}
    assert "candidate is better" in sinks.comparison_markdown([delta], verdict) and "keep the baseline" in sinks.comparison_markdown([delta | {"f1_delta": -0.1}], verdict)
    assert "- miss: 2" in sinks.document_markdown("d", [row("class_strict", 1.0)], [{"bucket": "miss"}] * 2)
