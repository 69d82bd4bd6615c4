"""Python is handed few rows at once, keeps the best hits of a task, and texts are not joined to be compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.operators import evaluate, vector
from hopweave.plans import qa_queries
from hopweave.plans.providers import ModelSpec, embed, generate
from hopweave.storage import BATCH_ROWS

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("make", [lambda d: d.select(embed(F.col("prompt"), ModelSpec())), lambda d: generate(d, ModelSpec())])
def test_f7_f8_f9_f10_batches_of_texts_are_bounded(spark, make):
    old = spark.conf.get(KEY)
    try:
        spark.conf.unset(KEY)
        d = make(spark.range(BATCH_ROWS * 2).select(F.concat(F.lit("word "), "id").alias("prompt")))
        assert spark.conf.get(KEY) == str(BATCH_ROWS) and len(d.collect()) == BATCH_ROWS * 2
        spark.conf.set(KEY, 700)  # a number of the session's own stays
        make(spark.createDataFrame([("a",)], "prompt string"))
        assert spark.conf.get(KEY) == "700"
    finally:
        spark.conf.set(KEY, old)


def test_f13_a_task_keeps_its_best_over_all_batches(spark):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-3, 4, (900, 5)).astype(float), rng.integers(-3, 4, (4, 5)).astype(float)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    old = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, 100)
        found = vector.top_k(queries, nodes, 7)
        got = {(r["query_id"], r["rank"]): r["node_id"] for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan()
        while "MapInPandas" not in plan.getClass().getSimpleName():
            plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan.plan() if "QueryStage" in plan.getClass().getSimpleName() else plan.children().head()
        assert plan.metrics().apply("pythonNumRowsReceived").value() == 4 * 7  # were 4 * 7 a batch
    finally:
        spark.conf.set(KEY, old)
    unit = lambda m, zero: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1) + (n == 0) * zero
    score = np.round(unit(q, 1 / np.sqrt(5)) @ unit(x, 0).T, 6)
    for i in range(4):
        assert [got[i, r] for r in range(1, 8)] == np.lexsort((np.arange(900), -score[i]))[:7].tolist()


def test_f14_texts_are_not_joined(spark, tmp_path):
    rows = [(1, "en", "A, b\tc"), (2, "en", "ab\tC!"), (3, "en", "ab c"), (4, "fr", None), (5, "fr", " . "), (6, None, "x"), (7, "de", "x y"), (8, "de", "x\ty")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = qa_queries.em_score(spark, str(tmp_path))
    assert "text#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["exact_match"] for r in got.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0, 7: 1.0, 8: 0.0}
    pairs = spark.createDataFrame([(a[2], b[2]) for a in rows for b in rows], "a string, b string")
    same = evaluate.normal_digest(F.col("a")) == evaluate.normal_digest(F.col("b"))
    assert pairs.where(same != (evaluate.exact_match(F.col("a"), F.col("b")) == 1.0)).count() == 0
