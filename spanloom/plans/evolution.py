"""Uncovered text to proposals: triage turns, routing of signals, bucket states, proposal turns.

The model behind triage and proposals is a provider; the loops here hold only block ids and budgets, the texts stay in
tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import parsing as P
from spanloom.functions import text as T
from spanloom.operators import evolve as V
from spanloom.operators import intervals as I
from spanloom.operators import residual as R


@dataclass
class TriageState:
    """active: blocks without a conclusion. budget: tool calls left for each. evidence: what tools gave."""

    active: set[int]
    budget: dict[int, int]
    conclusions: list[dict] = field(default_factory=list)
    evidence: dict[int, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class TriageConfig:
    turns: int = 10
    budget: int = 3


Tools = dict[str, Callable[[list[int], dict], dict[int, str]]]


def check_arguments(arguments: dict, schema: dict) -> list[str]:
    """What an object lacks or has too much against a schema of properties with types and required names."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    out = [f"missing {n}" for n in schema.get("required", ()) if n not in arguments]
    for name, value in arguments.items():
        rule = schema.get("properties", {}).get(name)
        if rule is None:
            out.append(f"unknown {name}")
        elif not isinstance(value, kinds[rule["type"]]) or (rule["type"] in ("integer", "number") and isinstance(value, bool)):
            out.append(f"{name} is no {rule['type']}")
        elif "enum" in rule and value not in rule["enum"]:
            out.append(f"{name} is none of {rule['enum']}")
    return out


def document_tools(docs: DataFrame, blocks: DataFrame, extractions: DataFrame, doc_id, level: str = "medium") -> Tools:
    """The tools of one document's triage, over tables keyed by doc_id: text around blocks, extractions near them, and the
    text of the section that a heading opens. docs: doc_id, text; blocks: residual blocks; extractions: class, text, start,
    end. Only what the asked blocks need is brought to the driver."""
    doc, own, spans = (x.where(F.col("doc_id") == F.lit(doc_id)) for x in (docs, blocks, extractions))
    headings = I.heading_rows(I.marked_lines(doc))
    of = lambda ids: own.where(F.col("block_id").isin(ids))

    def text(ids: list[int], arguments: dict) -> dict[int, str]:
        rows = R.neighbour_texts(doc, of(ids), arguments.get("level", level), drop_fences=bool(arguments.get("drop_fences")))
        return {r["block_id"]: json.dumps({"before": r["before"], "after": r["after"]}, ensure_ascii=False) for r in rows.collect()}

    def near(ids: list[int], arguments: dict) -> dict[int, str]:
        rows = I.neighbours(of(ids), spans, T.CONTEXT_SIZES[arguments.get("level", level)])
        return {r["block_id"]: json.dumps([{"class": n["class"], "text": n["text"]} for n in r["neighbours"]], ensure_ascii=False) for r in rows.collect()}

    def section(ids: list[int], arguments: dict) -> dict[int, str]:
        found = I.section_text(doc, headings, arguments["heading"]).first()
        return dict.fromkeys(ids, found["section"] if found else "")

    return {"neighbor_text": text, "neighbor_extractions": near, "section_text": section}


#: What a call of each tool may be given.
_LEVEL = {"type": "string", "enum": list(T.CONTEXT_SIZES)}
SCHEMAS = {
    "neighbor_text": {"properties": {"level": _LEVEL, "drop_fences": {"type": "boolean"}}},
    "neighbor_extractions": {"properties": {"level": _LEVEL}},
    "section_text": {"properties": {"heading": {"type": "string"}}, "required": ["heading"]},
}


def call_arguments(signals: list[dict], block_ids: list[int]) -> dict:
    """What the runtime adds to a tool call of a bucket's proposal: the one source document of the blocks asked for, their
    one extraction document if they have any, and the blocks. signals: block_id, doc_ref, extraction_doc_ref, text, tree,
    start, end."""
    chosen = [s for s in signals if s["block_id"] in set(block_ids)]
    if len(chosen) != len(block_ids):
        raise ValueError(f"unknown blocks: {sorted(set(block_ids) - {s['block_id'] for s in chosen})}")
    out: dict = {}
    for name in ("doc_ref", "extraction_doc_ref"):
        refs = {s.get(name) for s in chosen} - {None}
        if len(refs) > 1 or (name == "doc_ref" and not refs):
            raise ValueError(f"a tool call is about one {name}, not {sorted(refs)}")
        out |= {name: ref for ref in refs}
    return out | {"blocks": [{k: s.get(k) for k in ("block_id", "text", "tree", "start", "end")} for s in chosen]}


def triage(blocks: dict[int, str], provider, tools: Tools, config: TriageConfig | None = None, schemas: dict[str, dict] | None = None) -> TriageState:
    """Asks about the active blocks of one document until all have conclusions, nothing changes or the turns are used up.

    An answer is JSON: conclusions [{block_id, conclusion, reason}] and tools [{name, block_ids, arguments}]. A tool call
    costs each of its blocks one unit; blocks without budget are left out of it. A call whose arguments break its tool's
    schema isn't made: what is wrong with it is the evidence. Answers may be fenced."""
    config, schemas = config or TriageConfig(), SCHEMAS if schemas is None else schemas
    state = TriageState(set(blocks), dict.fromkeys(blocks, config.budget))
    for turn in range(config.turns):
        if not state.active:
            break
        asked = {"turn": turn, "blocks": [{"block_id": k, "text": blocks[k], "budget": state.budget[k], "evidence": state.evidence.get(k, [])} for k in sorted(state.active)]}
        answer, changed = P.load(provider.infer([json.dumps(asked, ensure_ascii=False)])[0]), False
        for c in answer.get("conclusions", []):
            if c["block_id"] in state.active:
                state.conclusions.append(c)
                state.active.discard(c["block_id"])
                changed = True
        for call in answer.get("tools", []):
            able = [k for k in call["block_ids"] if k in state.active and state.budget[k] > 0]
            if able and call["name"] in tools:
                given = call.get("arguments", {})
                wrong = check_arguments(given, schemas[call["name"]]) if call["name"] in schemas else []
                for k, text in (dict.fromkeys(able, "; ".join(wrong)) if wrong else tools[call["name"]](able, given)).items():
                    state.evidence.setdefault(k, []).append(text)
                for k in able:
                    state.budget[k] -= 1
                changed = True
        if not changed:
            break
    return state


def route_batch(signals: DataFrame, source: DataFrame, reason: DataFrame, config: V.RouteConfig | None = None) -> DataFrame:
    """Routes of a batch of signals (signal_id, source_vector, reason_vector) against two indexes of earlier ones."""
    c = config or V.RouteConfig()
    side = lambda v, index, name: V.nearest(signals.select(F.col("signal_id").alias("query_id"), F.col(v).alias("vector")), index, c.top_k, name)
    hits = side("source_vector", source, "source_index").unionByName(side("reason_vector", reason, "reason_index"))
    return V.routes(signals.select(F.col("signal_id").alias("query_id")), V.bucket_scores(V.fused(hits, c.fuse), c), c)


@dataclass(frozen=True)
class ProposalConfig:
    turns: int = 4


def propose(bucket: dict, provider, checker, config: ProposalConfig | None = None) -> dict:
    """A draft for one bucket's evidence, until the checker accepts it or the turns are used up.

    The checker's verdict moves the bucket: accepted drafts leave it stable, a split or no accepted draft makes it
    ambiguous."""
    config = config or ProposalConfig()
    feedback, draft, verdict = None, None, {}
    for _ in range(config.turns):
        draft = P.load(provider.infer([json.dumps({"bucket": bucket, "feedback": feedback}, ensure_ascii=False)])[0])
        verdict = P.load(checker.infer([json.dumps({"bucket": bucket, "draft": draft}, ensure_ascii=False)])[0])
        if verdict.get("accepted") or verdict.get("split_required"):
            break
        feedback = verdict.get("reason")
    fine = bool(verdict.get("accepted")) and not verdict.get("split_required")
    return {"bucket_id": bucket["bucket_id"], "draft": draft, "verdict": verdict, "status": "stable" if fine else "ambiguous"}


def merge_candidates(buckets: DataFrame) -> DataFrame:
    """Pairs of buckets to merge. No rule is set, so there are none."""
    return buckets.select(F.col("bucket_id").alias("a"), F.col("bucket_id").alias("b")).where(F.lit(False))
