"""Prompts, the model behind an interface, and a memo table so that no prompt is asked twice."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import parsing as P
from spanloom.functions import text as T


class Provider(Protocol):
    """Anything that answers prompts, in order."""

    def infer(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Example:
    """A text and the extractions that it should give: class, text, attributes."""

    text: str
    extractions: tuple[tuple[str, str, dict], ...] = ()


@dataclass(frozen=True)
class Template:
    """Fixed values of the prompt's layout by default."""

    description: str
    examples: tuple[Example, ...] = ()
    heading: str = "Examples"
    question: str = "Q: "
    answer: str = "A: "
    previous: str = "[Previous text]: ..."
    headings: str = "Heading context:\n"

    def answer_of(self, example: Example) -> str:
        items = [{c: t, f"{c}{P.ATTRIBUTES}": a} for c, t, a in example.extractions]
        return "```json\n" + json.dumps({P.WRAPPER: items}, ensure_ascii=False, indent=2) + "\n```"

    def prompt(self, question: Column, context: Column) -> Column:
        """The prompt of each row. All but question and context is one constant, made once."""
        shown = "".join(f"{self.question}{e.text}\n{self.answer}{self.answer_of(e)}\n\n" for e in self.examples)
        before = f"{self.heading}\n{shown}" if self.examples else ""
        told = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"))).otherwise("")
        return F.concat(F.lit(f"{self.description}\n\n"), told, F.lit(before + self.question), question, F.lit("\n" + self.answer))


def prompts(chunks: DataFrame, template: Template) -> DataFrame:
    """chunks (chunk_text and, if there, previous and context_text) with a prompt column."""
    parts = []
    if "previous" in chunks.columns:
        parts.append(F.when(F.col("previous").isNotNull(), F.concat(F.lit(template.previous), "previous")))
    if "context_text" in chunks.columns:
        parts.append(F.when(F.col("context_text").isNotNull(), F.concat(F.lit(template.headings), "context_text")))
    context = F.concat_ws("\n\n", *parts) if parts else F.lit("")
    return chunks.withColumn("prompt", template.prompt(F.col("chunk_text"), context))


@dataclass(frozen=True)
class Lookup:
    """Answers from a fixed table; unknown prompts get an empty list."""

    answers: dict[str, str]

    def infer(self, asked: list[str]) -> list[str]:
        return [self.answers.get(p, json.dumps({P.WRAPPER: []})) for p in asked]


@dataclass(frozen=True)
class Rules:
    """Answers by patterns on the question, as the output contract has them: (class, pattern, attributes)."""

    rules: tuple[tuple[str, str, dict], ...]
    question: str = "Q: "
    answer: str = "\nA: "

    def infer(self, asked: list[str]) -> list[str]:
        out = []
        for prompt in asked:
            body = prompt[prompt.rfind(self.question) + len(self.question) : prompt.rfind(self.answer)]
            found = sorted((m.start(), c, m.group(), a) for c, pattern, a in self.rules for m in re.finditer(pattern, body))
            out.append(json.dumps({P.WRAPPER: [{c: t, f"{c}{P.ATTRIBUTES}": a} for _, c, t, a in found]}, ensure_ascii=False))
        return out


@dataclass
class Router:
    """Which provider serves a model: the first matching pattern of the highest priority; a name can be given instead."""

    entries: list[tuple[int, str, str, Callable[..., Provider]]] = field(default_factory=list)

    def register(self, name: str, make: Callable[..., Provider], *patterns: str, priority: int = 0) -> None:
        self.entries += [(priority, pattern, name, make) for pattern in patterns]

    def resolve(self, model: str) -> Callable[..., Provider]:
        for _, pattern, _, make in sorted(self.entries, key=lambda e: -e[0]):
            if re.search(pattern, model):
                return make
        raise ValueError(f"no provider for model {model!r}")

    def named(self, name: str) -> Callable[..., Provider]:
        exact = [e for e in self.entries if e[1] == name]
        for e in exact or [e for e in self.entries if name.lower() in e[2].lower()]:
            return e[3]
        raise ValueError(f"no provider named {name!r}")


    def load_plugins(self, group: str = "spanloom.providers") -> list[str]:
        """Registers the providers that installed packages offer under an entry point group; their names. An entry point
        gives the maker, whose patterns and priority are attributes of it."""
        from importlib.metadata import entry_points

        found = list(entry_points(group=group))
        for entry in found:
            make = entry.load()
            self.register(entry.name, make, *getattr(make, "patterns", (f"^{entry.name}",)), priority=getattr(make, "priority", 0))
        return [entry.name for entry in found]


def load_template(path: str) -> Template:
    """A template of a YAML or JSON file: description, and examples of text and extractions."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text)
    items = lambda e: tuple((x["extraction_class"], x["extraction_text"], x.get("attributes") or {}) for x in e.get("extractions", ()))
    return Template(given["description"], tuple(Example(e["text"], items(e)) for e in given.get("examples", ())))


def ask(rows: DataFrame, provider: Provider, *, batch: int = 10, workers: int = 1) -> DataFrame:
    """rows (cache_key, prompt) with output and error. A failing batch has errors on its rows, not an exception.

    Batches of a task go out on up to `workers` threads and come back in order; limit the tasks by the partitions."""

    def one(asked: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(x, None) for x in provider.infer(asked)]
        except Exception as failed:  # noqa: BLE001 - the service may fail in any way; the row says how
            return [(None, f"{type(failed).__name__}: {failed}")] * len(asked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                texts = frame["prompt"].tolist()
                answers = [a for part in pool.map(one, [texts[k : k + batch] for k in range(0, len(texts), batch)]) for a in part]
                yield pd.DataFrame({"cache_key": frame["cache_key"], "output": [a for a, _ in answers], "error": [e for _, e in answers]})

    return rows.select("cache_key", "prompt").mapInPandas(run, "cache_key string, output string, error string")


def infer(asked: DataFrame, provider: Provider, memo: DataFrame | None = None, *, model: str = "model", batch: int = 10, workers: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows with prompt answered: (rows with cache_key, output, error; rows that are new to the memo table).

    Each distinct prompt is asked once, and not at all if the memo table (cache_key, output) has it."""
    keyed = asked.withColumn("cache_key", T.cache_key(model=F.lit(model), prompt=F.col("prompt")))
    new = keyed.select("cache_key", "prompt").dropDuplicates(["cache_key"])
    if memo is not None:
        new = new.join(memo.select("cache_key"), "cache_key", "left_anti")
    answered = ask(new, provider, batch=batch, workers=workers)
    known = answered if memo is None else answered.unionByName(memo.select("cache_key", "output", F.lit(None).cast("string").alias("error")))
    return keyed.join(known, "cache_key", "left"), answered.where("error IS NULL")
