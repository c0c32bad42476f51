import json

import pytest

from spanloom.operators import inference as N
from spanloom.plans import runs
from spanloom.sources import remote


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def item(text, cls="goal", **attributes):
    return {"extraction_class": cls, "extraction_text": text, "attributes": attributes, "alignment_status": "match_exact"}


@pytest.fixture
def project(tmp_path):
    put(tmp_path / "data/labels/d1.json", [item("one two three"), item("risk of rain", "risk")])
    put(tmp_path / "data/labels/d2.json", [item("never predicted")])
    entries = [{"doc_id": d, "label_path": f"labels/{d}.json", "document_path": f"docs/{d}.md"} for d in ("d1", "d2")]
    put(tmp_path / "data/registry.json", {"registry_name": "r", "domain": "k", "entries": entries})
    put(tmp_path / "good/d1/pred_d1.json", [item("One  two three"), item("risk of rain", "risk")])
    put(tmp_path / "bad/d1/pred_d1.json", [item("one two"), item("risk of rain", "goal")])
    common = {"dataset": {"registry_path": "data/registry.json"}, "domain_plugin": "x", "matcher": {"type": "m"}, "metrics": ["structured_strict", "structured_relaxed", "detection_strict", "detection_relaxed", "class_relaxed", "structure_anomaly_rate"], "report": {"output_dir": "reports"}}
    side = lambda name: {"path": name, "adapter": "list", "doc_subdir": True, "filename_template": "pred_{doc_id}.json"}
    put(tmp_path / "conf/a/eval.json", common | {"prediction": side("good")})
    put(tmp_path / "conf/a/compare.json", common | {"baseline": side("bad"), "candidate": side("good")})
    return tmp_path


def rows(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_evaluation_run(spark, project):
    config = runs.load_config(str(project / "conf/a/eval.json"))
    assert config["dataset"]["registry_path"] == str(project / "data/registry.json")
    out = runs.run_evaluation(spark, config, "t")
    micro = {r["metric"]: r for r in rows(project / "reports/eval_t/micro")}
    assert micro["structured_strict"]["f1"] == 1.0 and micro["detection_strict"]["tp"] == 2
    assert rows(project / "reports/eval_t/coverage") == [{"gold_docs": 2, "scored_docs": 1}]
    assert "usable level" in (project / "reports/eval_t/summary_report.md").read_text() and out.endswith("eval_t")
    assert runs.validate(spark, config) == []


def test_comparison_run(spark, project):
    runs.run_comparison(spark, runs.load_config(str(project / "conf/a/compare.json")), "t")
    summary = rows(project / "reports/compare_t/summary")[0]
    assert summary["improved_metric_count"] >= 2 and summary["degraded_metric_count"] == 0


def test_config_problems(spark, project):
    config = runs.load_config(str(project / "conf/a/eval.json"))
    assert runs.config_problems(config) == [] and runs.config_problems({"thresholds": {"x": 2}})[-1] == "Threshold out of range: x=2"
    assert "Missing baseline.adapter" in runs.config_problems({"baseline": {"path": "x"}}, comparison=True)
    with pytest.raises(ValueError, match="Missing config key"):
        runs.run_evaluation(spark, {}, "t")
    config["prediction"]["filename_template"] = "none_{doc_id}.json"
    with pytest.raises(ValueError, match="no prediction file"):
        runs.run_evaluation(spark, config, "t")


def test_remote_services(spark):
    chat = remote.ChatService("u", "m", system="s", transport=lambda u, b, h, t: json.dumps({"choices": [{"message": {"content": json.loads(b)["messages"][-1]["content"].upper()}}]}).encode())
    assert chat.infer(["a", "b", "c"]) == ["A", "B", "C"]
    one = remote.GenerateService("u", "m", transport=lambda u, b, h, t: json.dumps({"response": json.loads(b)["prompt"] * 2}).encode())
    assert one.infer(["x"]) == ["xx"]
    jobs, waits = {}, []

    def submit(part):
        jobs[str(len(jobs))] = part
        return str(len(jobs) - 1)

    service = remote.JobService(submit, lambda n: "done" if waits else "running", lambda n: {r["key"]: r["prompt"] for r in jobs[n] if r["prompt"] != "lost"}, waits.append, size=2)
    assert service.infer(["a", "lost", "c"]) == ["a", "", "c"] and len(jobs) == 2 and waits == [30]
    assert remote.download("u", transport=lambda *_: "é".encode("latin-1")) == "é"
    rows_, news = N.infer(spark.createDataFrame([(1, "p")], "k int, prompt string"), N.Lookup({"p": "1"}))
    assert rows_.first()["output"] == "1" and news.count() == 1


def test_template_file(tmp_path):
    put(tmp_path / "t.json", {"description": "d", "examples": [{"text": "x y", "extractions": [item("x", "c", k="v")]}]})
    assert N.load_template(str(tmp_path / "t.json")).examples[0].extractions == (("c", "x", {"k": "v"}),)
    assert N.Router().load_plugins("no.such.group") == []
