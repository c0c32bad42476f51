"""A whole evaluation as a bundle of tables, and the comparison of two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import evaluate as E
from spanloom.operators import schema as S
from spanloom.sources import shared, sinks


@dataclass
class Evaluation:
    micro: DataFrame
    macro_doc: DataFrame
    macro_class: DataFrame
    documents: DataFrame
    diagnostics: DataFrame
    errors: DataFrame
    samples: DataFrame
    coverage: DataFrame

    def report(self) -> str:
        """Markdown; only aggregates and the stated number of samples come to the driver."""
        rows = lambda f: [r.asDict() for r in f.collect()]
        return sinks.summary_markdown({"micro": rows(self.micro), "macro_doc": rows(self.macro_doc), "macro_class": rows(self.macro_class), "diagnostics": rows(self.diagnostics), "errors": rows(E.bucket_counts(self.errors)), "samples": rows(self.samples)})


def check_metrics(names: list[str]) -> tuple[list[str], list[str]]:
    """Matching metrics and diagnostics; an unknown name is an error."""
    diagnostics = ("structure_anomaly_rate", *(f"grounding_{s}_rate" for s in T.STATUSES))
    if unknown := [n for n in names if n not in (*E.METRICS, *diagnostics)]:
        raise ValueError(f"unknown metrics: {unknown}")
    return [n for n in names if n in E.METRICS], [n for n in names if n in diagnostics]


def evaluate(pred: DataFrame, gold: DataFrame, *, metrics: tuple[str, ...] = E.METRICS, thresholds: dict[str, float] | None = None, domain: S.Domain = S.DEFAULT, compatibility: bool = True) -> Evaluation:
    """Scores predictions on the gold documents that have any.

    Normal forms, matched pairs and counts are written to the shared folder once; the bundle's tables read those."""
    pred, gold = (shared.written(E.normalised(x, compatibility), "side") for x in (pred, gold))
    docs, coverage = E.scored_documents(pred, gold)
    docs = shared.written(docs, "scored")
    pred = pred.join(docs, "doc_id", "left_semi")
    relaxed = ("detection_relaxed", "class_relaxed", "structured_relaxed")  # the error buckets need these
    edges = shared.written(E.matched_edges(pred, gold, metrics=(*metrics, *relaxed), thresholds=thresholds, ignored=domain.ignored), "edges")
    documents, by_class = (shared.written(x, "counts") for x in E.all_counts(pred, gold, docs, edges, metrics))
    rate = E.anomaly_rate(pred, domain=domain).select(F.lit("structure_anomaly_rate").alias("metric"), "value", "numerator", "denominator")
    ground = E.grounding(pred).select(F.concat(F.lit("grounding_"), "status", F.lit("_rate")).alias("metric"), "value", "numerator", "denominator")
    errors = E.error_buckets(pred, gold, docs, edges=edges)
    return Evaluation(E.micro(documents), E.macro(documents), E.micro(by_class, ("class", "metric")), documents, rate.unionByName(ground), errors, E.error_samples(errors), coverage)


@dataclass
class Comparison:
    micro: DataFrame
    classes: DataFrame
    documents: DataFrame
    buckets: DataFrame
    diagnostics: DataFrame
    summary: DataFrame

    def report(self) -> str:
        return sinks.comparison_markdown([r.asDict() for r in self.micro.collect()], self.summary.first().asDict())


def compare(baseline: Evaluation, candidate: Evaluation) -> Comparison:
    """Deltas of two evaluations; needs the structured metrics in both."""
    values = ("precision", "recall", "f1")
    micro = E.deltas(baseline.micro, candidate.micro, ("metric",), values)
    each = lambda e: E.micro(e.documents, ("doc_id", "metric"))
    diagnostics = E.deltas(baseline.diagnostics, candidate.diagnostics, ("metric",), ("value",))
    return Comparison(micro, E.deltas(baseline.macro_class, candidate.macro_class, ("class", "metric"), values), E.deltas(each(baseline), each(candidate), ("doc_id", "metric"), values), E.deltas(E.bucket_counts(baseline.errors), E.bucket_counts(candidate.errors), ("bucket",), ("n",)), diagnostics, E.regression_summary(micro, diagnostics))


def gate(evaluation: Evaluation) -> dict:
    """The decision to accept a run. No rule is set, so every run passes."""
    return {"passed": True, "status": "passed", "reasons": [], "details": {}}
