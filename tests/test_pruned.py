"""Search over the clustered layout against the plain one, and how much it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.operators import pruned, vector


def rows(df):
    return sorted((r["query_id"], r["rank"], r["node_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "unrelated", "equal"])
def test_same_rows_as_the_plain_search(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2_000, 16))
    if kind == "clusters":
        x = 0.15 * x + 3 * rng.standard_normal((25, 16))[np.arange(2_000) % 25]
    if kind == "equal":
        x[:900] = x[0]
    corpus = [(i, v.tolist()) for i, v in enumerate(x)] + [(9_000, None), (9_001, [1.0]), (9_002, [float("nan")] * 16), (9_003, [0.0] * 16)]
    table = spark.createDataFrame(corpus, "node_id long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, (x[i] + 0.01).tolist()) for i in range(0, 40, 2)] + [(77, [0.0] * 16), (78, None), (79, [1.0, 2.0])], "query_id long, vector array<double>")
    path = str(tmp_path / "c")
    pruned.write_clustered(table, path, 16, clusters=25, rows=120)
    found = pruned.search(spark, queries.where("query_id <> 77"), path, 7)
    assert rows(found.hits) == rows(vector.top_k(queries.where("query_id not in (77, 79)"), table.where(F.size("vector") == 16), 7))
    assert rows(pruned.search(spark, queries, path, 7).hits) == rows(vector.top_k(queries.where("query_id <> 79"), table.where(F.size("vector") == 16), 7))
    assert found.pieces >= 17
    if kind == "clusters":
        assert found.read < found.pieces and pruned.search(spark, queries.where("query_id = 2"), path, 7).read <= 3
    assert rows(pruned.search(spark, queries.where("query_id = 4"), path, 5_000).hits) == rows(vector.top_k(queries.where("query_id = 4"), table.where(F.size("vector") == 16), 5_000))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "node_id long, vector array<double>")
    pruned.write_clustered(none, str(tmp_path / "c"), 4)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert pruned.search(spark, asked, str(tmp_path / "c")).hits.count() == 0
