import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanloom import catalog
from spanloom.operators import evolve as V
from spanloom.operators import intervals as I
from spanloom.sources import scans, sinks
from spanloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_csv_and_annotated(spark, tmp_path):
    path = put(tmp_path / "d.csv", 'id;body;other\n1;"a ""b""\nc";x\n2;d;y\n')
    assert [tuple(r) for r in scans.csv_documents(spark, path, id_key="id", text_key="body", delimiter=";").collect()] == [("1", 'a "b"\nc'), ("2", "d")]
    with pytest.raises(NotImplementedError):
        scans.csv_documents(spark, "x.txt", id_key="id", text_key="body")
    lines = [{"document_id": "d1", "text": "t", "extractions": [{"extraction_class": "c", "extraction_text": "t", "char_interval": {"start_pos": 0, "end_pos": 1}, "attributes": {"k": "v"}}]}, {"document_id": "d2", "text": "u"}]
    path = put(tmp_path / "a.jsonl", "\n\n".join(map(json.dumps, lines)) + "\n")
    docs = scans.annotated_documents(spark, path)
    assert docs.count() == 2 and tuple(scans.exploded(docs).first())[:6] == ("d1", 0, "c", "t", 0, 1)
    sinks.write_annotated(docs, str(tmp_path / "out"))
    assert {r["document_id"] for r in scans.annotated_documents(spark, str(tmp_path / "out")).collect()} == {"d1", "d2"}
    with pytest.raises(ValueError):
        sinks.write_annotated(docs.withColumn("document_id", F.lit(None).cast("string")), str(tmp_path / "none"))


def test_registry_gold_and_predictions(spark, tmp_path):
    put(tmp_path / "labels/a/d1/label.json", [{"extraction_class": "c", "extraction_text": "x", "attributes": {"k": "v"}}, {"extraction_class": "c", "extraction_text": "y"}])
    entries = [{"doc_id": "d1", "label_path": "labels/a/d1/label.json", "document_path": "/abs/d1.md"}, {"doc_id": "d2", "label_path": "x.json", "document_path": "y", "enabled": False}]
    path = put(tmp_path / "registry.json", {"registry_name": "r", "domain": "k", "entries": entries})
    rows = scans.registry(spark, path)
    assert [(r["doc_id"], r["document_path"]) for r in rows.collect()] == [("d1", "/abs/d1.md")] and scans.registry(spark, path, enabled_only=False).count() == 2
    assert [(r["doc_id"], r["idx"], r["text"], r["attributes"]) for r in scans.gold(spark, rows).orderBy("idx").collect()] == [("d1", 0, "x", {"k": "v"}), ("d1", 1, "y", {})]
    bad = put(tmp_path / "bad.json", {"not": "a list"})
    with pytest.raises(Exception, match="not a list"):
        scans.listed_extractions(spark, bad).collect()
    many = put(tmp_path / "p.jsonl", "\n".join(map(json.dumps, [{"doc_id": "a", "items": [{"extraction_class": "c", "extraction_text": "x"}]}, {"doc_id": "b", "extractions": []}])))
    assert {r["doc_id"]: len(r["extractions"]) for r in scans.prediction_documents(spark, many).collect()} == {"a": 1, "b": 0}
    lone = put(tmp_path / "one.json", {"extractions": []})
    assert scans.prediction_documents(spark, lone, doc_id="z").first()["doc_id"] == "z"
    with pytest.raises(Exception, match="no doc_id"):
        scans.prediction_documents(spark, lone).collect()


def test_registry_builder_and_paths(spark):
    labels = spark.createDataFrame([("set/a/d1", "label_v2.json"), ("set/a/d1", "label_v2_normalized.json"), ("set/d2", "label_v2.json"), ("set/d3", "odd.json"), ("set/d4", "label_v2.json")], "dir string, name string")
    docs = spark.createDataFrame([("x/d1", "README.md"), ("y/d2", "README.md"), ("z/d2", "README.md"), ("x/d4", "other.md")], "dir string, name string")
    rows = scans.build_registry(labels, docs).collect()
    assert [tuple(r) for r in rows] == [("d1", "set/a", "x/d1/README.md", "set/a/d1/label_v2_normalized.json", True)]
    files = spark.createDataFrame([("root/d1/p_d1.json",), ("root/d9/p_d9.json",)], "path string")
    found = scans.prediction_paths(spark.createDataFrame([("d1",), ("d2",)], "doc_id string"), files, "root", "p_{doc_id}.json").collect()
    assert [tuple(r) for r in found] == [("d1", "root/d1/p_d1.json")]
    assert scans.inferred_ids(spark.createDataFrame([("a/pred_doc7_v1.json",)], "path string")).first()["doc_id"] == "doc7"


def test_residual_conclusions_text(spark, tmp_path):
    path = put(tmp_path / "r.json", {"original_doc": "d", "blocks": [{"block_id": 3, "text": "t", "char_interval": {"start_pos": 1, "end_pos": 2}, "heading_tree": ["h"]}]})
    assert tuple(scans.residual_documents(spark, path).first()) == ("d", None, 3, "t", 1, 2, ["h"])
    items = [{"block_id": "1", "conclusion": "new_attr", "reason": "r"}, {"block_id": "2", "conclusion": "noise", "reason": "r"}]
    for k, body in enumerate(({"conclusions": items}, items)):
        assert [r["block_id"] for r in scans.conclusions(spark, put(tmp_path / f"c{k}.json", body)).collect()] == [1]
    (tmp_path / "latin.txt").write_bytes("é".encode("latin-1"))
    assert scans.text_files(spark, str(tmp_path / "latin.txt")).first()["text"] == "é"


def test_observer_and_stores(spark, tmp_path):
    put(tmp_path / "run1/chunks.jsonl", '{"payload":"x"}\n')
    tables = scans.observer_tables(spark, str(tmp_path), {})
    assert tables["chunks"].first()["run_id"] == "run1" and tables["prompts"].count() == 0
    sinks.write_observer({"chunks": tables["chunks"], "prompts": tables["prompts"]}, str(tmp_path / "out"))
    assert (tmp_path / "out/chunks/run_id=run1").exists() and not (tmp_path / "out/prompts").exists()
    sinks.append_json(spark.range(2), str(tmp_path / "store"))
    sinks.append_json(spark.range(1), str(tmp_path / "store"))
    assert scans.json_store(spark, str(tmp_path / "store"), "id long").count() == 3


def test_highlight(spark):
    spans = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 3), (1, 2, 5, 7)], "doc_id int, span_id int, start int, end int")
    events = [r.asDict() for r in I.highlight_events(spans).orderBy("ord").collect()]
    assert [(e["span_id"], e["event"]) for e in events] == [(0, "start"), (1, "start"), (1, "end"), (0, "end"), (2, "start"), (2, "end")]
    page = sinks.highlight_html("ab<de fg", events, {0: "x", 1: "y", 2: "x"})
    assert "&lt;" in page and page.count("</span>") == 5


def test_signal_stream(spark, tmp_path):
    source, schema = tmp_path / "in", "signal_id string, bucket_id int, doc_ref string, created_at long"
    spark.createDataFrame([("a", 1, "d1", 1), ("a", 2, "d1", 2), ("b", 2, "d2", 1)], schema).write.parquet(f"{source}/one")
    state = ingest.SignalState(spark, str(tmp_path / "state"), schema)
    run = lambda: ingest.run_available(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source)), state.upsert, str(tmp_path / "check")).awaitTermination()
    run()
    assert {r["signal_id"]: r["bucket_id"] for r in state.current().collect()} == {"a": 2, "b": 2}
    spark.createDataFrame([("b", 3, "d2", 5)], schema).write.parquet(f"{source}/two")
    run()
    assert {r["signal_id"]: r["bucket_id"] for r in state.current().collect()} == {"a": 2, "b": 3}
    assert {r["bucket_id"]: r["docs"] for r in state.support().collect()} == {2: 1, 3: 1}


def test_routing_stream(spark, tmp_path):
    schema = "signal_id string, doc_ref string, source_embedding_text string, reason_embedding_text string, created_at long"
    router = ingest.Router(spark, str(tmp_path), V.RouteConfig(similarity="cosine", threshold=0.5))
    router.route(spark.createDataFrame([("a", "d1", "red green blue", "why not", 1), ("b", "d2", "", "", 1)], schema), 0)
    router.route(spark.createDataFrame([("c", "d2", "red green blue", "why not", 2), ("d", "d3", "other words here", "no idea", 2)], schema), 1)
    found = {r["signal_id"]: r["bucket_id"] for r in router.mappings.current().collect()}
    assert found == {"a": "bucket_a", "b": "bucket_b", "c": "bucket_a", "d": "bucket_d"}
    router.route(spark.createDataFrame([("c", "d2", "red green blue", "why not", 2)], schema), 1)  # the batch again
    assert {r["bucket_id"]: (r["members"], r["docs"]) for r in router.buckets().collect()}["bucket_a"] == (["a", "c"], 2)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations", "events", "embeddings", "benchmark", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    result = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(str(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
