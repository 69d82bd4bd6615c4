"""The engine with images, failing retrievers and judges; SQL functions against the Column ones; odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from hopweave import cli
from hopweave.config import Settings
from hopweave.functions import text
from hopweave.functions.register import register_all
from hopweave.operators import vector
from hopweave.plans import providers
from hopweave.plans.providers import ModelSpec
from hopweave.plans.retrieval import Engine
from hopweave.sources import nodes as sources
from hopweave.storage import fresh

SPEC = ModelSpec()
ASKED = "question_id long, question string, information struct<text:string,images:array<string>>"


def engine(spark, **more):
    rows = [(1, "red apples on a tree", "s", "text"), (2, "blue boats at sea", "s", "text"), (3, "a chart of sales", "sales.png", "image"), (4, "a map of rivers", "rivers.png", "image")]
    table = spark.createDataFrame(rows, "node_id long, text string, source string, modality string")
    v = F.when(F.col("modality") == "text", providers.embed(F.col("text"), SPEC)).otherwise(providers.embed_image(F.col("source"), SPEC))
    return Engine(spark, table.withColumn("vector", v), **more)


def test_images_of_a_question(spark):
    """A question's images find the node of the same image, those without images go by their text."""
    q = spark.createDataFrame([(7, "what is shown", ["rivers.png"]), (8, "what is shown", ["sales.png", "sales.png"]), (9, "sales png", [])], "query_id long, question string, images array<string>")
    got = engine(spark, settings=Settings(rerank_enabled=False)).retrieve(q, "cross_modal").where("position = 1").collect()
    assert {r["query_id"]: r["node_id"] for r in got} == {7: 4, 8: 3, 9: 3} and all(r["modality"] == "image" for r in got)


def test_models_of_their_own(spark):
    """Another image model has another dimension; a reranking model orders the hits."""
    small = ModelSpec(dim=16)
    e = engine(spark, reranker=SPEC, image_embedder=small)
    e.nodes = e.nodes.withColumn("vector", F.when(F.col("modality") == "image", providers.embed_image(F.col("source"), small)).otherwise(F.col("vector")))
    q = spark.createDataFrame([(1, "blue boats")], "query_id long, question string")
    hits = e.retrieve(q, "hybrid").orderBy("position").collect()
    assert [r["modality"] for r in hits] == ["text", "text", "image", "image"] and hits[0]["node_id"] == 2 and hits[0]["score"] == 0.5
    assert e.info()["cross_modal"] == {"built_in": True, "modality": "image", "model": "stub"} and e.available() == ["cross_modal", "local_text"]


def test_a_failing_method_is_left_out(spark):
    def broken(queries, k):
        raise OSError("down")

    e = engine(spark)
    e.register("cross_modal", broken)
    q = spark.createDataFrame([(1, "red apples")], "query_id long, question string")
    assert {r["modality"] for r in e.retrieve(q, "hybrid").collect()} == {"text"}
    e.register("local_text", broken)
    assert e.retrieve(q, "hybrid").count() == 0


def test_evaluation_with_a_judge_and_resume(spark, tmp_path):
    spec = ModelSpec(options=(("Rate the answer", "4 of 5"), ("Rate your confidence", "Score: 1")))
    path = tmp_path / "samples.json"
    path.write_text('{"examples": [{"uid": "a", "query": "red apples", "reference_answer": "stub answer to red apples", "meta_info": {"query_type": "multi_hop"}}, {"uid": "b", "query": "x", "ground_truth": {"answer": "y"}}]}')
    samples = sources.scan_samples(spark, str(path))
    done = cli.evaluated(engine(spark, llm=spec, settings=Settings(gated=True)), samples)
    got = {r["uid"]: r for r in done.collect()}
    assert (got["a"]["exact_match"], got["a"]["accuracy"], got["a"]["query_type"]) == (1.0, 1.0, "multi_hop")
    assert got["b"]["error"] and (got["b"]["exact_match"], got["b"]["accuracy"]) == (0.0, 0.0) and got["b"]["reference_answer"] == "y"
    out = fresh(spark, "evaluation")
    sources.append_jsonl(done.where("uid = 'a'"), out)
    assert [r["uid"] for r in sources.resume(samples, sources.read_results(spark, out, cli.RESULT)).collect()] == ["b"]
    assert sources.scan_samples(spark, str(tmp_path / "absent.json")).columns == samples.columns


def test_sql_functions_are_the_column_functions(spark):
    register_all(spark)
    odd = ["a\xa0b　c", " the  cat. \x1c sat! ", "", "x\x85y", "The the them theme"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    df.createOrReplaceTempView("odd")
    got = spark.sql("select t, hw_words(t) w, hw_collapse(t) c, hw_strip(t) s, hw_sentences(t) n, hw_content_tokens(t) k, hw_valid_query(t) v, hw_sort_number(t || 7) o from odd").collect()
    t = F.col("t")
    want = df.select("t", text.words(t), text.collapse(t), text.strip(t), text.sentences(t), text.tokens(t), text.valid_query(t), F.lit(7)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0]["w"] == ["a", "b", "c"] and got[4]["k"] == ["The", "theme"]


def test_search_without_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, [float("nan")] * 8) for i in range(10)] + [(200, [None] + [1.0] * 7), (201, [float("inf")] * 8), (202, [1e200] * 8)]
    df = spark.createDataFrame(rows, "node_id long, vector array<double>")
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    for size in (vector.BROADCAST_BYTES, 0):
        got = vector.top_k(df.withColumnRenamed("node_id", "query_id"), df, 10, broadcast_bytes=size).toPandas()
        assert set(got.query_id) == {*range(60), 202} and got.groupby("query_id").size().eq(10).all()
        best = got[got["rank"] == 1].set_index("query_id").node_id
        assert all(best[i] == i for i in range(60)) and best[202] == 202
        few = got[(got.query_id == 5) & (got.node_id < 100)].node_id.tolist()
        assert few == [i for i in np.argsort(-np.round(unit @ unit[5], 6), kind="stable")[:10].tolist() if i in few]
