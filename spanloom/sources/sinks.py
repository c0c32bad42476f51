"""Writers."""

from __future__ import annotations

import html
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.evaluate import METRICS


def write_annotated(documents: DataFrame, path: str) -> None:
    """JSON lines of documents that have an id; none at all is an error. Token intervals aren't kept."""
    rows = documents.where(F.col("document_id").isNotNull())
    if rows.isEmpty():
        raise ValueError("no document to write")
    rows.drop("token_interval").write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_observer(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per table, partitioned by run; tables without rows aren't written."""
    for name, rows in tables.items():
        if not rows.isEmpty():
            rows.write.mode("append").partitionBy("run_id").json(f"{path}/{name}")


def _line(name: str, r: dict) -> str:
    return f"- {name}: precision={r['precision']:.4f}, recall={r['recall']:.4f}, f1={r['f1']:.4f}, tp={r['tp']}, fp={r['fp']}, fn={r['fn']}"


@dataclass(frozen=True)
class Remark:
    """A sentence about one figure of a report, given when the figure is at least `low` or at most `high`."""

    figure: str
    says: str
    low: float = -math.inf
    high: float = math.inf


#: The bounds from which a figure counts as a strength, a risk, or asks for action; and how many buckets are named.
USABLE_RELAXED, WEAK_STRICT = 0.5, 0.4
HIGH_GROUNDING, LOW_ANOMALIES, MANY_ANOMALIES = 0.7, 0.05, 0.1
TOP_BUCKETS = 3

#: Fixed titles of the report.
MICRO, MACRO_DOC, MACRO_CLASS = "Micro Results", "Macro Doc Results", "Macro Class Results"
DIAGNOSTICS, BUCKETS, KEY_RISKS = "Diagnostic Results", "Error Buckets", "Key Risks"

STRENGTHS = (
    Remark("structured_relaxed", "matching by text and attributes has come to a usable level", low=USABLE_RELAXED),
    Remark("grounding_match_exact_rate", "most extractions stand in the text word for word", low=HIGH_GROUNDING),
    Remark("structure_anomaly_rate", "the schema is kept nearly always", high=LOW_ANOMALIES),
)
RISKS = (
    Remark("structured_strict", "attributes are often wrong where texts are right", high=math.nextafter(WEAK_STRICT, 0)),
    Remark("structure_anomaly_rate", "the schema is broken often enough to hold back a rollout", low=math.nextafter(MANY_ANOMALIES, 1)),
)
ACTIONS = (
    Remark("structured_relaxed", "tune prompts and clean-up by this metric and its strict form"),
    Remark("structure_anomaly_rate", "mend breaks of the schema before the matching", low=math.nextafter(0, 1)),
)


def _remarks(remarks: tuple[Remark, ...], figures: dict[str, float]) -> list[str]:
    return [f"- {r.figure} = {figures[r.figure]:.4f}: {r.says}." for r in remarks if r.figure in figures and r.low <= figures[r.figure] <= r.high]


def _section(title: str, lines: list[str], level: int = 2) -> list[str]:
    return [f"{'#' * level} {title}", "", *lines, ""]


def summary_markdown(summary: dict) -> str:
    """A report of collected metric tables: micro, macro_doc, macro_class, diagnostics, errors, samples, as lists of
    dicts. It ends with what stands out, by fixed bounds, and what to do next."""
    ranked = lambda rows: sorted(rows, key=lambda r: METRICS.index(r["metric"]))
    metrics = lambda rows: [_line(r["metric"], r) for r in ranked(rows)]
    classes: dict[str, list[dict]] = {}
    for r in summary["macro_class"]:
        classes.setdefault(r["class"], []).append(r)
    out = ["# Evaluation", "", *_section(MICRO, metrics(summary["micro"])), *_section(MACRO_DOC, metrics(summary["macro_doc"])), *_section(MACRO_CLASS, [])]
    for name in sorted(classes):
        out += _section(name, metrics(classes[name]), 3)
    out += _section(DIAGNOSTICS, [f"- {r['metric']}: {r['value']:.4f} ({r['numerator']}/{r['denominator']})" for r in summary["diagnostics"]])
    out += _section(BUCKETS, [f"- {r['bucket']}: {r['n']}" for r in summary["errors"]])
    if summary.get("samples"):
        out += _section("Examples of errors", [f"- {json.dumps(r, ensure_ascii=False, default=str)}" for r in summary["samples"]])
    figures = {r["metric"]: r["f1"] for r in summary["micro"]} | {r["metric"]: r["value"] for r in summary["diagnostics"]}
    figures.setdefault("structured_strict", 0.0)
    largest = [r for r in sorted(summary["errors"], key=lambda r: (-r["n"], r["bucket"]))[:TOP_BUCKETS] if r["n"]]
    risks = _remarks(RISKS, figures) + [f"- {r['n']} errors are of the kind {r['bucket']}." for r in largest]
    actions = _remarks(ACTIONS, figures) + [f"- look at the examples of {r['bucket']} before labels or schema are changed." for r in largest]
    out += _section("What stands out", [])
    out += _section("Strengths", _remarks(STRENGTHS, figures) or ["- none by the bounds of this report."], 3)
    out += _section(KEY_RISKS, risks or ["- none by the bounds of this report."], 3)
    out += _section("Next steps", actions or ["- none."], 3)
    return "\n".join(out)


def document_markdown(doc_id: object, rows: list[dict], errors: list[dict]) -> str:
    """The report of one document: its metrics, and its errors by bucket."""
    counts: dict[str, int] = {}
    for r in errors:
        counts[r["bucket"]] = counts.get(r["bucket"], 0) + 1
    metrics = [f"- {r['metric']}: tp={r['tp']}, fp={r['fp']}, fn={r['fn']}" for r in sorted(rows, key=lambda r: METRICS.index(r["metric"]))]
    return "\n".join([f"# Document {doc_id}", "", *_section("Metrics", metrics), *_section("Errors", [f"- {k}: {n}" for k, n in sorted(counts.items())])])


def comparison_markdown(metrics: list[dict], verdict: dict) -> str:
    """A report of micro deltas, the regression summary, and how to read them."""
    change = {r["metric"]: r["f1_delta"] for r in metrics}
    rows = [f"- {r['metric']}: F1 {r['baseline_f1']:.4f} -> {r['candidate_f1']:.4f}, ΔF1={r['f1_delta']:+.4f}" for r in sorted(metrics, key=lambda r: METRICS.index(r["metric"]))]
    counts = ", ".join(f"{k.split('_')[0]}: {verdict[k]}" for k in ("improved_metric_count", "degraded_metric_count", "unchanged_metric_count"))
    relaxed, strict = (change.get(f"structured_{k}", 0.0) for k in ("relaxed", "strict"))
    worse = relaxed < 0 or strict < 0
    reading = "the structured metrics fell: keep the baseline." if worse else "the structured metrics rose: the candidate is better." if relaxed > 0 else "the structured metrics hardly moved: nothing is decided."
    out = ["# Comparison", "", *_section("Micro", rows), *_section("Verdict", [f"- {verdict['overall_assessment']}.", f"- {verdict['core_metric_assessment']}.", f"- {counts}."])]
    out += _section("How to read it", [f"- {reading}"])
    return "\n".join(out + _section("Next steps", ["- the tables by document and class show where the change comes from; those of errors and diagnostics, of what kind it is."]))


#: Characters of a view around its spans.
CONTEXT = 150
PALETTE = ("#D2E3FC", "#C8E6C9", "#FEF0C3", "#F9DEDC", "#FFDDBE", "#EADDFF", "#C4E9E4", "#FCE4EC", "#E8EAED", "#DDE8E8")


def highlight_html(text: str, events: list[dict], classes: dict[int, str]) -> str:
    """A document's text with its spans marked. events: rows of highlight_events in order; classes: by span."""
    colour = {c: PALETTE[k % len(PALETTE)] for k, c in enumerate(sorted(set(classes.values())))}
    legend = " ".join(f'<span style="background:{v}">{html.escape(c)}</span>' for c, v in colour.items())
    first, last = min((e["pos"] for e in events), default=0), max((e["pos"] for e in events), default=0)
    at, out = max(0, first - CONTEXT), []
    for e in events:
        out.append(html.escape(text[at : e["pos"]]))
        at = e["pos"]
        out.append(f'<span data-span="{e["span_id"]}" style="background:{colour[classes[e["span_id"]]]}">' if e["event"] == "start" else "</span>")
    out.append(html.escape(text[at : last + CONTEXT]))
    return f'<div class="legend">{legend}</div><div class="text">{"".join(out)}</div>'
