"""Scans, sinks, the question pipeline and streaming ingestion on small files."""

import json

from pyspark.sql import functions as F

from hopweave.config import Settings
from hopweave.plans import providers
from hopweave.plans.providers import ModelSpec
from hopweave.plans.retrieval import Engine
from hopweave.sources import nodes
from hopweave.streaming.ingest import ingest


def write(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_nodes(spark, tmp_path):
    d = tmp_path / "n"
    write(d, "a.node", {"text": "x", "embedding": [[3.0, 4.0]], "metadata": {"file_path": "./data/x.txt"}})
    write(d, "b.node", [{"content": "y", "vector": [0.0, 2.0], "image_path": "p.png"}, 7, {"text": "no vector"}])
    write(d, "c.node", "{broken")
    got = {r["id"]: r for r in nodes.scan_nodes(spark, str(d), "/root").collect()}
    assert set(got) == {"a", "b"}
    assert [round(x, 3) for x in got["a"]["embedding"]] == [0.6, 0.8] and got["a"]["file_path"] == "/root/x.txt" and got["a"]["modality"] == "text"
    assert got["b"]["text"] == "y" and got["b"]["modality"] == "image"
    out = str(tmp_path / "table")
    nodes.write_nodes(nodes.scan_nodes(spark, str(d)).drop("metadata"), out)
    assert nodes.read_nodes(spark, out, 2).count() == 2 and nodes.read_nodes(spark, out, 3).count() == 0


def test_corpus_and_pending(spark, tmp_path):
    d = tmp_path / "c"
    write(d, "a.json", {"text": "hello"})
    write(d, "b.json", "{broken")
    write(d, ".hidden.json", {"text": "no"})
    write(d, "x.JPG", "raw")
    files = nodes.scan_corpus(spark, str(d))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.json", "b.json"]
    assert [r["text"] for r in nodes.load_texts(files).collect()] == ["hello"]
    done = spark.createDataFrame([("/o/a.node",)], "path string")
    assert [r["stem"] for r in nodes.pending(files, done).collect()] == ["b"]


def test_samples(spark, tmp_path):
    write(tmp_path / "s", "e.json", {"examples": [{"uid": "1", "query": "q"}, {"query": "r", "meta_info": {"query_type": "multi_hop"}}]})
    rows = nodes.scan_samples(spark, str(tmp_path / "s/e.json")).collect()
    assert [r["query"] for r in rows] == ["q", "r"] and rows[1]["meta_info"]["query_type"] == "multi_hop"
    assert nodes.scan_samples(spark, str(tmp_path / "absent.json")).count() == 1


def test_legacy_and_images(spark, tmp_path):
    write(tmp_path / "l", "c.json", {"corpus": [{"id": "1", "text": "t"}], "image_corpus": [{"id": "2", "image_path": "a.png", "description": "d"}]})
    got = {r["id"]: (r["modality"], r["text"]) for r in nodes.scan_legacy(spark, str(tmp_path / "l/c.json")).collect()}
    assert got == {"1": ("text", "t"), "2": ("image", "d")}
    files = spark.createDataFrame([("p/a.png", bytearray(b"x")), ("p/a.jpg", bytearray(b"y"))], "path string, content binary")
    wanted = spark.createDataFrame([("p/a",), ("p/z",)], "image_path string")
    got = {r["image_path"]: r["uri"] for r in nodes.encode_images(wanted, files).collect()}
    assert got == {"p/a": "data:image/jpeg;base64,eQ==", "p/z": None}


def test_settings(spark):
    assert Settings().updated(rerank_top_k=3, unknown=1).rerank_top_k == 3
    spark.conf.set("spark.hopweave.rerank_top_k", "4")
    assert Settings.from_session(spark).rerank_top_k == 4
    spark.conf.unset("spark.hopweave.rerank_top_k")


def test_providers():
    slept = []
    assert providers.attempted(lambda: 1 / 0, 3, 2.0, slept.append)[0] == "" and slept == [2.0, 4.0]
    stub = providers.model(ModelSpec(provider="unknown"))
    assert stub.generate("Question: who") == "stub answer to who" and stub.embed("a b") != stub.embed("c d")
    path, body = providers.HttpModel(ModelSpec(model="some-vl")).request("p", "data:x")
    assert path == "/chat/completions" and len(body["messages"][0]["content"]) == 2


def test_pipeline(spark):
    spec = ModelSpec()
    rows = [(1, "paris is the capital of france", "a", "text"), (2, "berlin is the capital of germany", "b", "text"), (3, "a picture of rome", "c", "image")]
    table = spark.createDataFrame(rows, "node_id long, text string, source string, modality string").withColumn("vector", providers.embed(F.col("text"), spec))
    engine = Engine(spark, table, llm=spec, embedder=spec)
    asked = spark.createDataFrame([(1, "capital of france", ("", [])), (2, "Compare the capital of france and germany", ("", [])), (3, " ", ("", []))], "question_id long, question string, information struct<text:string,images:array<string>>")
    got = {r["question_id"]: r for r in engine.answer(asked, "hybrid").collect()}
    assert got[1]["sources"] == ["Q1"] and got[1]["n_hits"] == 3 and got[1]["answer"]
    assert got[2]["sources"] == ["Q1", "Q2"] and got[3]["error"]
    assert engine.available() == ["cross_modal", "local_text"]


def test_stream(spark, tmp_path):
    d, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(d, "a.json", {"text": "one"})
    ingest(spark, str(d), out, mark)
    write(d, "b.json", {"text": "two"})
    ingest(spark, str(d), out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
