"""Model output to extraction rows. Each output is read once, in Arrow batches; errors are a column, never an exception."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed keys of the output contract.
WRAPPER, ATTRIBUTES, INDEX = "extractions", "_attributes", "_index"
FENCED = r"(?s)```([A-Za-z0-9_+-]+)?[ \t]*(?:\n|$)(.*?)```"
THINK = r"(?s)<think>.*?</think>"
#: Tags of a fence by format. Fixed values.
TAGS = {"json": ("json",), "yaml": ("yaml", "yml")}
#: Groups of entries in their order. kind: string, integer, number, object, list or null; values that aren't strings or
#: numbers are JSON text.
GROUPS = "array<array<struct<key:string,value:string,kind:string>>>"
_ENTRY = pa.struct([("key", pa.string()), ("value", pa.string()), ("kind", pa.string())])
_PARSED = pa.struct([("groups", pa.list_(pa.list_(_ENTRY))), ("error", pa.string())])
_FENCED, _THINK = re.compile(FENCED), re.compile(THINK)


class OutputError(ValueError):
    """What is wrong with an output."""


def fenced(text: str, tag: str = "json", strict: bool = False) -> str:
    """The content. Lenient: one fence of the tag or of none, else the only fence, else the whole text. Strict: exactly
    one fence of the tag."""
    found = [((m.group(1) or "").lower(), m.group(2).strip()) for m in _FENCED.finditer(text)] if "```" in text else []
    fits = [body for own, body in found if own in TAGS[tag] or (not own and not strict)]
    if strict and len(fits) != 1:
        raise OutputError("expected exactly one fence")
    if len(fits) > 1 or (not fits and len(found) > 1):
        raise OutputError("several fences")
    return fits[0] if fits else found[0][1] if found else text.strip()


def without_fence(text: Column) -> Column:
    """A leading fence mark and a trailing one dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^```(?:json|yaml|yml)?\s*", ""), r"\s*```$", "")


def _read(content: str, tag: str) -> Any:
    try:
        if tag == "json":
            return json.loads(content)
        import yaml

        try:
            return yaml.safe_load(content)
        except yaml.YAMLError as error:
            raise OutputError("not YAML") from error
    except (ValueError, RecursionError) as error:
        raise OutputError(f"not {tag.upper()}") from error


def load(text: str, tag: str = "json", strict: bool = False) -> Any:
    """The value of an output. Text in think tags goes if the content can't be read with it."""
    content = fenced(text, tag, strict)
    if not content:
        raise OutputError("empty output")
    try:
        return _read(content, tag)
    except OutputError:
        plain = content if strict else _THINK.sub("", content).strip()
        if plain == content:
            raise
        return _read(plain, tag)


def _entry(key: Any, value: Any) -> dict[str, str]:
    if not isinstance(key, str):
        raise OutputError("a key is not a string")
    if isinstance(value, str):
        shown, kind = value, "string"
    elif isinstance(value, int | float):
        shown, kind = str(value), "integer" if isinstance(value, int) else "number"
    elif isinstance(value, dict | list):
        shown, kind = json.dumps(value, ensure_ascii=False, default=str), "object" if isinstance(value, dict) else "list"
    else:
        shown, kind = None if value is None else str(value), "null" if value is None else "string"
    whole = lambda x: x if x is None or x.isascii() else x.encode("utf-8", "replace").decode()  # noqa: E731, half characters
    return {"key": whole(key), "value": whole(shown), "kind": kind}


def groups(text: str | None, tag: str = "json", strict: bool = False, bare_list: bool = True) -> list[list[dict[str, str]]]:
    """The extraction groups of an output."""
    value = load(text or "", tag, strict)
    items = value.get(WRAPPER) if isinstance(value, dict) else value if bare_list and not strict else None
    if not isinstance(items, list):
        raise OutputError(f"no {WRAPPER} list")
    if not all(isinstance(x, dict) for x in items):
        raise OutputError("an item is not an object")
    return [[_entry(k, v) for k, v in x.items()] for x in items]


def parse_outputs(frame: DataFrame, output: str = "output", *, tag: str = "json", strict: bool = False) -> DataFrame:
    """frame with the columns groups and parse_error. tag: json or yaml. A null output is an empty one."""

    @F.arrow_udf(f"groups {GROUPS}, error string")
    def parsed(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append({"groups": groups(text, tag, strict)})
            except OutputError as error:
                out.append({"error": str(error)})
        return pa.array(out, type=_PARSED)

    staged = frame.withColumn("_parsed", parsed(F.col(output).cast("string")))
    return staged.withColumn("groups", F.col("_parsed.groups")).withColumn("parse_error", F.col("_parsed.error")).drop("_parsed")


def value_error(entry: Column, index_suffix: str | None = None) -> Column:
    """What is wrong with an entry of a group, or null: texts are strings or numbers, attributes objects, indexes integers."""
    key, kind = entry["key"], entry["kind"]
    index = key.endswith(index_suffix) if index_suffix else F.lit(False)
    return (
        F.when(index, F.when(kind != "integer", F.concat(F.lit("index must be an integer: "), key)))
        .when(key.endswith(ATTRIBUTES), F.when(~kind.isin("object", "null"), F.concat(F.lit("attributes must be an object: "), key)))
        .when(kind.isin("object", "list", "null"), F.concat(F.lit("extraction text must be a string or number: "), key))
    )


def first_value_error(found: Column, index_suffix: str | None = None) -> Column:
    """The first such error of all groups, or null."""
    return F.try_element_at(F.filter(F.transform(F.flatten(found), lambda e: value_error(e, index_suffix)), lambda x: x.isNotNull()), F.lit(1))


def flatten(frame: DataFrame, keys: list[str], index_suffix: str | None = None) -> DataFrame:
    """A row for each extraction of each group: keys, group_index, extraction_index, class, text, attributes.

    Keys with the attribute suffix belong to the class before it. Without an index suffix extractions are numbered from
    1 through all groups; with one, those without an index are left out. Entries with a value_error stop the job.
    """

    def of(group: Column, key: Column) -> Column:
        return F.try_element_at(F.filter(group, lambda e: e["key"] == key), F.lit(1))["value"]

    def extraction(group: Column, entry: Column, at: Column) -> Column:
        wrong = value_error(entry, index_suffix)
        index = [of(group, F.concat(entry["key"], F.lit(index_suffix))).cast("int").alias("index")] if index_suffix else []
        text = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(entry["value"])
        return F.struct(at.alias("group_index"), entry["key"].alias("class"), text.alias("text"), of(group, F.concat(entry["key"], F.lit(ATTRIBUTES))).alias("attributes"), *index)

    def kept(entry: Column) -> Column:
        sound = value_error(entry, index_suffix).isNull()
        return ~sound | ~(entry["key"].endswith(ATTRIBUTES) | (entry["key"].endswith(index_suffix) if index_suffix else F.lit(False)))

    listed = F.flatten(F.transform("groups", lambda g, at: F.transform(F.filter(g, kept), lambda e: extraction(g, e, at))))
    if index_suffix:
        listed = F.filter(listed, lambda x: x["index"].isNotNull())
    rows = frame.select(*keys, F.posexplode(listed).alias("_place", "_x"))
    attributes = F.from_json("_x.attributes", "map<string,string>").alias("attributes")
    named = [*keys, F.col("_x.group_index").alias("group_index"), F.col("_x.class").alias("class"), F.col("_x.text").alias("text"), attributes]
    if index_suffix:
        order = Window.partitionBy(*keys).orderBy("_index", "_place")
        rows = rows.select(*named, F.col("_x.index").alias("_index"), "_place")
        return rows.withColumn("extraction_index", F.row_number().over(order)).drop("_index", "_place")
    return rows.select(*named, (F.col("_place") + 1).alias("extraction_index"))


def render(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The output contract's text for the extractions of each key: columns class, text, attributes."""
    item = F.concat(F.lit("{"), F.to_json(F.create_map("class", "text")).substr(F.lit(2), F.length(F.to_json(F.create_map("class", "text"))) - 2), F.lit(","), F.to_json(F.create_map(F.concat("class", F.lit(ATTRIBUTES)), F.coalesce("attributes", F.create_map().cast("map<string,string>")))).substr(F.lit(2), F.length(F.to_json(F.create_map(F.concat("class", F.lit(ATTRIBUTES)), F.coalesce("attributes", F.create_map().cast("map<string,string>"))))) - 1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(f'{{"{WRAPPER}":['), F.array_join(listed, ","), F.lit("]}")).alias("output"))


def response_schema(examples: DataFrame) -> DataFrame:
    """(class, attribute, is_list) over example extractions: what a schema of the output must allow."""
    each = examples.select("class", F.explode_outer("attributes").alias("attribute", "value"))
    return each.groupBy("class", "attribute").agg(F.max(F.coalesce(F.col("value").startswith("["), F.lit(False))).alias("is_list"))


def json_schema(rows: list) -> dict:
    """A JSON schema of the output contract from the rows of response_schema: every class may be there, as text, with an
    object of its attributes."""
    properties: dict = {}
    for r in sorted(rows, key=lambda r: (r["class"], r["attribute"] or "")):
        properties[r["class"]] = {"type": "string"}
        own = properties.setdefault(r["class"] + ATTRIBUTES, {"type": "object", "properties": {}, "nullable": True})
        if r["attribute"] is not None:
            own["properties"][r["attribute"]] = {"type": "array", "items": {"type": "string"}} if r["is_list"] else {"type": "string"}
    return {"type": "object", "properties": {WRAPPER: {"type": "array", "items": {"type": "object", "properties": properties}}}, "required": [WRAPPER]}
