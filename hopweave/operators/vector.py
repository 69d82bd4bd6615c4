"""Vector normalisation, similarity, exact top-k, multi-vector averaging, hybrid union and reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.text import jaccard
from hopweave.storage import bounded_batches

#: Query vectors up to this many bytes travel with the closure; larger sets are joined in tiles.
BROADCAST_BYTES = 64_000_000
TILE_ROWS = 4_000


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(_square(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize_query(v: Column) -> Column:
    """v / |v|; a zero vector becomes the uniform unit vector."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 1e-8, x.cast("double") / n).otherwise(1 / F.sqrt(F.size(v).cast("double"))))


def normalize_corpus(v: Column) -> Column:
    """v / |v|; a zero vector stays (about) zero, divided by the root of its length."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n < 1e-8, F.sqrt(F.size(v).cast("double"))).otherwise(n))


def of_dimension(df: DataFrame, column: str, d: int) -> DataFrame:
    """Rows whose vector has the dimension; others are dropped, as are nulls."""
    return df.where(F.size(column) == d)


def add_batch(store: DataFrame, batch: DataFrame, column: str, d: int) -> DataFrame:
    """Append a batch, normalised if any of its norms is off by over 1e-4; one wrong dimension rejects it whole."""
    state = batch.agg(F.count_if(F.coalesce(F.size(column), F.lit(-1)) != d).alias("bad"), F.count_if(F.abs(norm(F.col(column)) - 1) > 1e-4).alias("off")).first()
    if state["bad"]:
        return store
    return store.unionByName(batch.withColumn(column, normalize_corpus(F.col(column)).cast(store.schema[column].dataType)) if state["off"] else batch)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a guarded denominator, clamped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b) + 1e-10)))


def _unit(ids: pd.Series, rows: pd.Series, zero_uniform: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows without null or non-finite components."""
    x = np.stack(rows.to_numpy()).astype(np.float64)
    good = np.isfinite(x).all(1)
    x = x[good]
    top = np.abs(x).max(1, keepdims=True, initial=0)  # keeps squares of very long vectors finite
    n = top * np.sqrt(((x / np.where(top > 0, top, 1)) ** 2).sum(1, keepdims=True))
    d = np.sqrt(x.shape[1])
    return ids.to_numpy()[good], np.where(n > 1e-8, x / np.where(n > 0, n, 1), 1 / d if zero_uniform else x / d)


def _first(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k hits of each query."""
    return hits.sort_values(["query_id", "score", "node_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, threshold: float | None) -> pd.DataFrame:
    """The best k of one block for each query, by rounded score and id."""
    out = []
    for s in range(0, len(qids) if len(ids) else 0, 512):
        score = np.round(q[s : s + 512] @ x.T, 6) + 0.0
        m = min(k, score.shape[1])
        edge = np.partition(score, score.shape[1] - m, 1)[:, score.shape[1] - m]
        i, j = np.nonzero(score >= np.maximum(edge, -np.inf if threshold is None else threshold)[:, None])
        got = pd.DataFrame({"query_id": qids[s + i], "node_id": ids[j], "score": score[i, j]})
        out.append(_first(got, k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "node_id": [], "score": []})


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact search by inner product of unit vectors: query_id, rank, node_id, score (6 decimals).

    queries: (query_id long, vector); corpus: (node_id long, vector). Vectors are normalised (zero query:
    uniform, zero node: zero); nodes of another dimension than the query's, nulls, and vectors with null or
    non-finite components are never hits, and such queries have none. Every task keeps its best k per query before anything is shuffled; ties go to the smaller node_id.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    queries = queries.where("vector is not null and size(vector) > 0")
    corpus = corpus.where("vector is not null and size(vector) > 0")
    size = queries.agg(F.sum(8 * F.size("vector") + 16).alias("b")).first()["b"] or 0
    schema = "query_id long, node_id long, score double"
    if size <= broadcast_bytes:
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toPandas()  # at most broadcast_bytes
        groups = {d: _unit(g["query_id"], g["vector"], True) for d, g in asked.groupby(asked["vector"].map(len))}
        shared = spark.sparkContext.broadcast(groups)

        def scan(batches):
            best: dict[int, pd.DataFrame] = {}
            for pdf in batches:
                for d, g in pdf.groupby(pdf["vector"].map(len)):
                    if d in shared.value:
                        found = _best(*shared.value[d], *_unit(g["node_id"], g["vector"], False), k, threshold)
                        best[d] = _first(pd.concat([best[d], found]), k) if d in best else found
            yield from best.values()

        partial = corpus.select("node_id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(scan, schema)
    else:
        nq, nc = -(-queries.count() // TILE_ROWS), -(-corpus.count() // TILE_ROWS)
        deal = lambda df, i, own, other: df.select(F.lit(i == "query_id").alias("is_query"), F.col(i).alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64(i), F.lit(own)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(max(other - 1, 0)))).alias("far"))
        tiles = deal(queries, "query_id", nq, nc).select("*", F.col("own").alias("tq"), F.col("far").cast("long").alias("tc")).unionByName(
            deal(corpus, "node_id", max(nc, 1), nq).select("*", F.col("far").cast("long").alias("tq"), F.col("own").alias("tc"))
        )

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            q, c = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
            if not len(q) or not len(c):
                return _best(np.zeros(0), None, np.zeros(0), None, k, threshold)
            return _best(*_unit(q["id"], q["vector"], True), *_unit(c["id"], c["vector"], False), k, threshold)

        partial = tiles.withColumn("d", F.size("vector")).groupBy("d", "tq", "tc").applyInPandas(tile, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "node_id", "score")


def multi_vector_average(hits: DataFrame, k: int) -> DataFrame:
    """Fuse the hits of several query vectors: rows (question_id, image_seq, rank, text, score, node_id) -> per text the mean over its hits.

    The metadata (node_id) is that of the first hit seen; ties in the mean go to the text.
    """
    mean = hits.groupBy("question_id", "text").agg(
        F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n_hits"), F.min_by("node_id", F.struct("image_seq", "rank")).alias("node_id")
    )
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "text")
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_union(parts: list[tuple[str, str, DataFrame]], rerank_k: int) -> DataFrame:
    """Union of ranked hit lists (modality, retrieval_source, hits): the first list's hits come first, no scores are mixed.

    Fewer than two lists give the first one alone.
    """
    out = None
    for order, (modality, source, hits) in enumerate(parts):
        tagged = hits.where(F.col("rank") <= rerank_k).withColumns({"modality": F.lit(modality), "retrieval_source": F.lit(source), "modality_order": F.lit(order)})
        out = tagged if out is None else out.unionByName(tagged)
    place = Window.partitionBy("query_id").orderBy("modality_order", "rank")
    return out.withColumn("position", F.row_number().over(place))


def rerank(hits: DataFrame, score: Column, k: int, text: str = "text", key: str = "query_id") -> DataFrame:
    """Score hits anew and keep the best k; hits without text keep their old score and compete."""
    kept = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.col("score")).otherwise(score)
    again = hits.withColumnRenamed("rank", "old_rank").withColumn("score", F.round(kept, 6))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "old_rank")
    return again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("old_rank")


def truncate(hits: DataFrame, k: int) -> DataFrame:
    """Reranking switched off: retrieval order, first k."""
    return hits.where(F.col("rank") <= k)


def lexical_score(question: Column, text: Column) -> Column:
    """The deterministic stand-in for a reranking model."""
    return jaccard(question, text)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left join with the first matching row of the right side, by ``order``."""
    firsts = right.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in columns))
    return left.join(firsts, key, "left")


def add_one(store: DataFrame, node: DataFrame, column: str, d: int) -> DataFrame:
    """Append single nodes: those of another dimension are dropped, those off the unit length are normalised."""
    right = of_dimension(node, column, d)
    kind = store.schema[column].dataType
    fixed = F.when(F.abs(norm(F.col(column)) - 1) > 1e-4, normalize_query(F.col(column)).cast(kind)).otherwise(F.col(column))
    return store.unionByName(right.withColumn(column, fixed))


def cleared(store: DataFrame) -> DataFrame:
    """An empty store of the same shape."""
    return store.limit(0)


def store_size(store: DataFrame, column: str) -> int:
    """The number of searchable nodes: those that have a vector."""
    return store.where(F.col(column).isNotNull()).count()
