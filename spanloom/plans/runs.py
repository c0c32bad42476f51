"""Configured runs: files in, report folder out. Configuration and reports are the driver's; the data stay in tables."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import evaluate as E
from spanloom.plans import evaluation
from spanloom.sources import scans, sinks

_PATHS = (("dataset", "registry_path"), ("prediction", "path"), ("baseline", "path"), ("candidate", "path"), ("report", "output_dir"))
_COMMON = ("domain_plugin", "matcher", "metrics", "report")


def load_config(path: str) -> dict:
    """A YAML or JSON mapping. Relative paths are taken from the project folder two levels up, or from the file's own if
    only that has them."""
    text, base = Path(path).read_text(encoding="utf-8"), Path(path).resolve().parent
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError("a config must be a mapping")
    for section, key in _PATHS:
        part = config.get(section)
        if isinstance(part, dict) and part.get(key) and not Path(part[key]).is_absolute():
            ours, own = (base.parent.parent / part[key]).resolve(), (base / part[key]).resolve()
            part[key] = str(own if own.exists() and not ours.exists() else ours)
    return config


def config_problems(config: dict, *, comparison: bool = False) -> list[str]:
    """What a config lacks, and thresholds out of range."""
    needed = ("dataset", *(("baseline", "candidate") if comparison else ("prediction",)), *_COMMON)
    out = [f"Missing config key: {k}" for k in needed if k not in config]
    for side in ("baseline", "candidate") if comparison else ():
        if isinstance(config.get(side), dict):
            out += [f"Missing {side}.{k}" for k in ("path", "adapter") if k not in config[side]]
    return out + [f"Threshold out of range: {k}={v}" for k, v in config.get("thresholds", {}).items() if not 0 <= float(v) <= 1]


@dataclass(frozen=True)
class _Sides:
    gold: DataFrame
    docs: DataFrame


def _gold(spark: SparkSession, config: dict) -> _Sides:
    entries = scans.registry(spark, config["dataset"]["registry_path"])
    return _Sides(scans.gold(spark, entries), entries.select("doc_id", "domain"))


def predictions(spark: SparkSession, section: dict, docs: DataFrame) -> DataFrame:
    """Evaluation rows of one side's predictions. adapter "json": prediction documents; any other: one list per file."""
    if section.get("adapter") == "json":
        rows = scans.prediction_documents(spark, section["path"]).select("doc_id", F.posexplode("extractions").alias("idx", "_e"))
        return rows.select("doc_id", "idx", F.col("_e.extraction_class").alias("class"), F.col("_e.extraction_text").alias("text"), F.coalesce("_e.attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.col("_e.alignment_status").alias("alignment_status"))
    template, by_folder = section.get("filename_template", "pred_{doc_id}.json"), bool(section.get("doc_subdir", False))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(section["path"]).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    found = scans.prediction_paths(docs, listed, section["path"].rstrip("/"), template, by_folder)
    paths = [r["path"] for r in found.collect()]  # file names of registered documents: configuration
    if not paths:
        raise ValueError(f"no prediction file under {section['path']}")
    rows = scans.listed_extractions(spark, paths).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return rows.join(found, "path").drop("path", "start", "end")


def _evaluated(spark: SparkSession, config: dict, section: dict, sides: _Sides) -> evaluation.Evaluation:
    matching, _ = evaluation.check_metrics(config["metrics"])
    return evaluation.evaluate(predictions(spark, section, sides.docs), sides.gold, metrics=tuple(matching), thresholds=config.get("thresholds"))


def _write(config: dict, name: str, tables: dict[str, DataFrame], markdown: str, stamp: str) -> str:
    """A folder of the report's name and stamp: tables as JSON lines in sub-folders, the summary, the config."""
    out = Path(config["report"]["output_dir"]) / f"{name}_{stamp}"
    out.mkdir(parents=True, exist_ok=True)
    formats = config["report"].get("formats", ["json", "markdown"])
    if "json" in formats:
        for title, rows in tables.items():
            rows.write.mode("overwrite").json(str(out / title))
    if "markdown" in formats:
        (out / "summary_report.md").write_text(markdown, encoding="utf-8")
        if "documents" in tables and "errors" in tables and "bucket" in tables["errors"].columns:
            _write_documents(tables["documents"], tables["errors"], str(out / "document_reports"))
    (out / "run_config.json").write_text(json.dumps(config, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(out)


def _write_documents(counts: DataFrame, errors: DataFrame, path: str) -> None:
    """A Markdown report for each document, one a row: written where the documents lie, so nothing is collected."""
    own = counts.groupBy("doc_id").agg(F.collect_list(F.struct("metric", "tp", "fp", "fn")).alias("m"))
    found = errors.groupBy("doc_id").agg(F.collect_list(F.struct("bucket")).alias("e"))

    @F.arrow_udf("string")
    def rendered(ids: pa.Array, metrics: pa.Array, buckets: pa.Array) -> pa.Array:
        return pa.array([sinks.document_markdown(i, m, e or []) for i, m, e in zip(*(x.to_pylist() for x in (ids, metrics, buckets)), strict=True)], type=pa.string())

    own.join(found, "doc_id", "left").select("doc_id", rendered(F.col("doc_id").cast("string"), "m", "e").alias("markdown")).write.mode("overwrite").json(path)


def run_evaluation(spark: SparkSession, config: dict, stamp: str) -> str:
    """Evaluates as configured; the folder written. stamp: names the run, so that runs can be repeated."""
    if problems := config_problems(config):
        raise ValueError("; ".join(problems))
    done = _evaluated(spark, config, config["prediction"], _gold(spark, config))
    for line in E.report_lines([r.asDict() for r in done.micro.collect()]):
        print(line)
    tables = {"micro": done.micro, "macro_doc": done.macro_doc, "macro_class": done.macro_class, "documents": done.documents, "diagnostics": done.diagnostics, "errors": done.errors, "coverage": done.coverage}
    return _write(config, "eval", tables, done.report(), stamp)


def run_comparison(spark: SparkSession, config: dict, stamp: str) -> str:
    """Evaluates baseline and candidate and compares them; needs both structured metrics."""
    problems = config_problems(config, comparison=True)
    problems += [f"Comparison needs {m}" for m in ("structured_strict", "structured_relaxed") if m not in config.get("metrics", ())]
    if problems:
        raise ValueError("; ".join(problems))
    sides = _gold(spark, config)
    change = evaluation.compare(*(_evaluated(spark, config, config[s], sides) for s in ("baseline", "candidate")))
    tables = {"micro": change.micro, "classes": change.classes, "documents": change.documents, "buckets": change.buckets, "diagnostics": change.diagnostics, "summary": change.summary}
    return _write(config, "compare", tables, change.report(), stamp)


def validate(spark: SparkSession, config: dict) -> list[dict]:
    """Problems of the dataset and, if configured, of the predictions."""
    sides = _gold(spark, config)
    found = [r.asDict() for r in E.dataset_problems(sides.docs).collect()]
    if "prediction" in config:
        found += [r.asDict() for r in E.prediction_problems(predictions(spark, config["prediction"], sides.docs), sides.docs).collect()]
    return found


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom")
    parser.add_argument("command", choices=("run", "compare", "validate"))
    parser.add_argument("config")
    parser.add_argument("--stamp", default="run")
    given = parser.parse_args(arguments)
    spark, config = SparkSession.builder.getOrCreate(), load_config(given.config)
    if given.command == "validate":
        print(json.dumps(validate(spark, config), ensure_ascii=False, indent=2))
    else:
        print((run_evaluation if given.command == "run" else run_comparison)(spark, config, given.stamp))


if __name__ == "__main__":
    main()
