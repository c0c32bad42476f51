"""Readers. All schemas are given, so no reader infers by scanning; missing fields are nulls, never failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.evolve import proposing

INTERVAL = "struct<start_pos:int,end_pos:int>"
EXTRACTION = f"struct<extraction_class:string,extraction_text:string,char_interval:{INTERVAL},alignment_status:string,extraction_index:int,group_index:int,description:string,attributes:map<string,string>>"
PREDICTION = f"struct<extraction_class:string,extraction_text:string,attributes:map<string,string>,alignment_status:string,char_interval:{INTERVAL}>"
OBSERVED = ("blocks", "skipped_blocks", "containers", "chunk_decisions", "chunks", "prompts", "llm_calls", "parses", "extractions")


def csv_documents(spark: SparkSession, path: str, *, id_key: str, text_key: str, delimiter: str = ",") -> DataFrame:
    """(document_id, text) of a delimited file with a header, both as text; other columns aren't read."""
    if not path.rstrip("/").endswith(".csv"):
        raise NotImplementedError(f"only .csv is read here: {path}")
    rows = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col(id_key).cast("string").alias("document_id"), F.col(text_key).cast("string").alias("text"))


def annotated_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text, extractions) of JSON lines; blank lines are skipped."""
    return spark.read.schema(f"document_id string, text string, extractions array<{EXTRACTION}>").json(path)


def exploded(documents: DataFrame, id_column: str = "document_id") -> DataFrame:
    """One row per extraction: id, ord, class, text, start, end, alignment_status, attributes."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.posexplode("extractions").alias("ord", "_e"))
    field = lambda n: F.col(f"_e.{n}")
    return rows.select("doc_id", "ord", field("extraction_class").alias("class"), field("extraction_text").alias("text"), field("char_interval.start_pos").alias("start"), field("char_interval.end_pos").alias("end"), field("alignment_status").alias("alignment_status"), field("attributes").alias("attributes"))


def registry(spark: SparkSession, path: str, *, enabled_only: bool = True) -> DataFrame:
    """The entries of a registry with its name and domain, and paths resolved against its folder."""
    entry = "struct<doc_id:string,doc_type:string,document_path:string,label_path:string,enabled:boolean,metadata:map<string,string>>"
    whole = spark.read.schema(f"registry_name string, version string, domain string, schema_version string, entries array<{entry}>").option("multiLine", True).json(path)
    folder = path.rsplit("/", 1)[0]
    rows = whole.select("registry_name", "version", "domain", "schema_version", F.explode("entries").alias("_e"))
    rows = rows.select("registry_name", "version", "domain", "schema_version", "_e.doc_id", "_e.doc_type", *(resolved(F.col(f"_e.{c}"), folder).alias(c) for c in ("document_path", "label_path")), F.coalesce("_e.enabled", F.lit(True)).alias("enabled"), "_e.metadata")
    return rows.where("enabled") if enabled_only else rows


def resolved(path: Column, folder: str) -> Column:
    """Absolute paths and addresses stay, others are under the folder."""
    return F.when(path.rlike(r"^(/|[a-z][a-z0-9+.-]*:)"), path).otherwise(F.concat_ws("/", F.lit(folder), path))


def preferred_labels(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Of label files (dir, name) the one of each folder whose name comes first in `names`; others don't count."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    return files.where(F.col("name").isin(*names)).withColumn("_r", rank).groupBy("dir").agg(F.min_by("name", "_r").alias("name"))


def build_registry(labels: DataFrame, documents: DataFrame, names: tuple[str, ...] = ("label_v2_normalized.json", "label_v2.json"), document_name: str = "README.md") -> DataFrame:
    """Entries for labels (dir, name) under the label folder and documents (dir, name) under the document folder: the
    document of a label folder is the only one in a folder of that name."""
    chosen = preferred_labels(labels, names).withColumn("doc_id", F.element_at(F.split("dir", "/"), -1))
    docs = documents.where(F.col("name") == document_name).withColumn("doc_id", F.element_at(F.split("dir", "/"), -1)).groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("dir").alias("_d")).where("_n = 1")
    return chosen.join(docs, "doc_id").select("doc_id", F.regexp_replace("dir", r"(^|/)[^/]*$", "").alias("doc_type"), F.concat_ws("/", "_d", F.lit(document_name)).alias("document_path"), F.concat_ws("/", "dir", "name").alias("label_path"), F.lit(True).alias("enabled"))


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files; content that isn't UTF-8 is read as Latin-1."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    sound = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    return files.select("path", F.coalesce(sound, F.decode("content", "ISO-8859-1")).alias("text"))


def listed_extractions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, idx, class, text, attributes, alignment_status, start, end) of files that hold one JSON list each."""
    files = text_files(spark, paths)
    items = F.from_json("text", f"array<{PREDICTION}>")
    bad = F.raise_error(F.concat(F.lit("not a list of extractions: "), F.col("path"))).cast(f"array<{PREDICTION}>")
    rows = files.select("path", F.posexplode(F.when(F.ltrim(F.regexp_replace("text", r"^\s+", "")).startswith("["), items).otherwise(bad)).alias("idx", "_e"))
    return rows.select("path", "idx", F.col("_e.extraction_class").alias("class"), F.col("_e.extraction_text").alias("text"), F.coalesce("_e.attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.col("_e.alignment_status").alias("alignment_status"), F.col("_e.char_interval.start_pos").alias("start"), F.col("_e.char_interval.end_pos").alias("end"))


def gold(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Extractions of the registry's label files by document, as evaluation rows. The registry is configuration: its
    paths are listed by the driver."""
    paths = [r["label_path"] for r in entries.select("label_path").collect()]
    rows = listed_extractions(spark, paths)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return entries.select("doc_id", plain(F.col("label_path")).alias("_p")).join(rows, F.col("_p") == plain(F.col("path"))).drop("_p", "path")


def prediction_documents(spark: SparkSession, path: str, *, doc_id: str | None = None) -> DataFrame:
    """Rows of prediction documents, JSON or JSON lines; extractions may be called items. doc_id: for a single document
    that has none; otherwise a missing one is an error on its row."""
    item = f"array<{PREDICTION}>"
    rows = spark.read.schema(f"doc_id string, domain string, split string, text string, metadata map<string,string>, extractions {item}, items {item}").option("multiLine", not path.endswith(".jsonl")).json(path)
    missing = F.lit(doc_id) if doc_id else F.raise_error(F.lit("a prediction document has no doc_id")).cast("string")
    return rows.select(F.coalesce("doc_id", missing).alias("doc_id"), "domain", "split", "text", "metadata", F.coalesce("extractions", "items", F.array().cast(item)).alias("extractions"))


def prediction_paths(gold_ids: DataFrame, files: DataFrame, root: str, template: str, by_folder: bool = True) -> DataFrame:
    """(doc_id, path) of the files (path) that hold the predictions of gold documents; {doc_id} is filled in."""
    name = F.replace(F.lit(template), F.lit("{doc_id}"), F.col("doc_id"))
    want = F.concat_ws("/", F.lit(root), F.col("doc_id"), name) if by_folder else F.concat_ws("/", F.lit(root), name)
    return gold_ids.select("doc_id", want.alias("path")).join(files.select("path").distinct(), "path", "left_semi").select("doc_id", "path")


def inferred_ids(files: DataFrame) -> DataFrame:
    """files (path) with the document that their names tell."""
    return files.withColumn("doc_id", T.doc_id_of(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)))


def residual_documents(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(doc_ref, extraction_doc_ref, block_id, text, start, end, tree); resblocks may be called blocks, refs in two ways.
    lines: files of one document a line, else one document a file."""
    block = f"array<struct<block_id:int,text:string,char_interval:{INTERVAL},heading_tree:array<string>>>"
    rows = spark.read.schema(f"original_doc_ref string, original_doc string, extraction_doc_ref string, extraction_doc string, resblocks {block}, blocks {block}").option("multiLine", not lines).json(path)
    rows = rows.select(F.coalesce("original_doc_ref", "original_doc").alias("doc_ref"), F.coalesce("extraction_doc_ref", "extraction_doc").alias("extraction_doc_ref"), F.explode(F.coalesce("resblocks", "blocks")).alias("_b"))
    return rows.select("doc_ref", "extraction_doc_ref", "_b.block_id", "_b.text", F.col("_b.char_interval.start_pos").alias("start"), F.col("_b.char_interval.end_pos").alias("end"), F.col("_b.heading_tree").alias("tree"))


def conclusions(spark: SparkSession, path: str) -> DataFrame:
    """Conclusions that lead to proposals, of an object with a list of them or of a list."""
    item = "array<struct<block_id:string,text:string,conclusion:string,reason:string,related_old_schema_name:string,confidence:double>>"
    files = text_files(spark, path)
    body = F.regexp_replace("text", r"^\s+", "")
    listed = F.when(body.startswith("["), F.from_json(body, item)).otherwise(F.from_json(body, f"conclusions {item}")["conclusions"])
    return proposing(files.select(F.explode(listed).alias("_c")).select("_c.*").withColumn("block_id", F.col("block_id").cast("int")))


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def observer_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The record tables of all runs under a folder, each with its run_id; tables that no run wrote are empty."""
    out = {}
    for name in OBSERVED:
        schema = schemas.get(name, "payload string")
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.jsonl").json(root)
        out[name] = rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return out


def observed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The records of one table as write_observer keeps them, with their run_id."""
    return spark.read.schema(f"{schema}, run_id string").json(f"{root}/{name}")


def numbered(rows: DataFrame, by: str, order: str, name: str = "idx") -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("int"))
