"""Exact top-k that skips files: a clustered layout whose pieces have a center and a radius.

``write_clustered`` puts unit vectors into pieces, one folder each (``piece=...``, at most some ``rows`` rows): vectors of
one k-means cluster, of which a piece is a part by hash, so a cluster of any size is many pieces. For a unit query q and
any x of a piece of center c and radius r, q.x <= q.c + r by Cauchy and Schwarz. ``search`` first reads, for each query, the pieces of the
highest bounds until they hold k vectors; the k-th score found is a bound from below, and of the other pieces only those are
read whose bound from above reaches it. Everything else is left out by partition pruning, exactly: the hits are those of ``vector.top_k``.

The centers come from a sample of SAMPLE rows, which decides how much is skipped, never what is found. Vectors that are
null, empty, of another dimension or not finite are not written.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.operators.vector import _best, _unit
from hopweave.storage import checkpointed

#: Rows the centers are fitted on, most clusters, rows of a piece, and bytes of queries that travel with the closure.
SAMPLE, CLUSTERS, ROWS, BROADCAST_BYTES = 20_000, 1_024, 50_000, 64_000_000
#: Scores are compared by six decimals; a piece whose bound is less than this below the k-th score may still hold an equal one.
_SLACK = 1e-6
_VECTORS = "node_id long, vector array<double>, cluster int, distance double, piece string"


def _centers(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from evenly spread rows; empty clusters keep their center."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centers.T - 0.5 * (centers**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def write_clustered(corpus: DataFrame, path: str, dim: int, clusters: int | None = None, rows: int = ROWS) -> None:
    """(node_id, vector) as pieces under ``path``/vectors, and what is known of them under ``path``/pieces and ``path``/centers."""
    spark = corpus.sparkSession
    good = corpus.where(F.size("vector") == dim).select(F.col("node_id").cast("long").alias("node_id"), F.col("vector").cast("array<double>").alias("vector"))
    n = good.count()
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    hashed = good.withColumn("h", F.xxhash64("node_id", "vector")).where(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    sample = hashed.orderBy("h").limit(SAMPLE).select("node_id", "vector").toPandas()
    x = _unit(sample["node_id"], sample["vector"], False)[1] if len(sample) else np.zeros((1, dim))
    centers = _centers(x if len(x) else np.zeros((1, dim)), max(1, min(CLUSTERS, len(x), clusters or int(np.sqrt(n)))))
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        for pdf in batches:
            ids, unit = _unit(pdf["node_id"], pdf["vector"], False)
            c = shared.value
            near = (unit @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
            yield pd.DataFrame({"node_id": ids, "vector": list(unit), "cluster": near, "distance": np.sqrt(((unit - c[near]) ** 2).sum(1))})

    placed = good.mapInPandas(assign, "node_id long, vector array<double>, cluster int, distance double")
    parts = placed.groupBy("cluster").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # at most CLUSTERS rows
    dealt = placed.join(F.broadcast(parts), "cluster").withColumn("piece", F.concat_ws("-", "cluster", F.pmod(F.xxhash64("node_id"), F.col("parts"))))
    dealt.drop("parts").repartition("piece").write.partitionBy("piece").parquet(f"{path}/vectors")
    written = spark.read.schema(_VECTORS).parquet(f"{path}/vectors")
    written.groupBy("piece").agg(F.first("cluster").alias("cluster"), F.max("distance").alias("radius"), F.count("*").alias("n")).write.parquet(f"{path}/pieces")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")


@dataclass
class Found:
    """hits: query_id, rank, node_id, score; read: the pieces that were read, of all."""

    hits: DataFrame
    read: int
    pieces: int


def search(spark: SparkSession, queries: DataFrame, path: str, k: int = 10) -> Found:
    """Exact search by inner product of unit vectors over a clustered layout, for queries (query_id, vector) of at most BROADCAST_BYTES."""
    queries = queries.where("vector is not null and size(vector) > 0")
    size = queries.agg(F.sum(8 * F.size("vector") + 16).alias("b")).first()["b"] or 0
    if size > BROADCAST_BYTES:
        raise ValueError("too many queries at once: search them in parts, or by vector.top_k")
    known = spark.read.parquet(f"{path}/pieces").orderBy("piece").toPandas()
    centers = np.stack([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("cluster").collect()])
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toPandas()
    asked = asked[asked["vector"].map(len) == centers.shape[1]]
    none = spark.createDataFrame([], "query_id long, rank int, node_id long, score double")
    if not len(asked) or not len(known):
        return Found(none, 0, len(known))
    qids, q = _unit(asked["query_id"], asked["vector"], True)
    bounds = (q @ centers.T)[:, known["cluster"]] + known["radius"].to_numpy()
    order = np.argsort(-bounds, axis=1)
    before = np.cumsum(known["n"].to_numpy()[order], axis=1) - known["n"].to_numpy()[order]
    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, order, before < k, 1)  # the highest bounds, until k vectors are there

    vectors = spark.read.schema(_VECTORS).parquet(f"{path}/vectors")

    def scan(wanted: np.ndarray) -> pd.DataFrame | None:
        """The best k of each query in its wanted pieces, read by partition."""
        names = known["piece"].to_numpy()
        of_piece: dict = defaultdict(list)
        for i, j in zip(*np.nonzero(wanted)):
            of_piece[names[j]].append(i)
        if not of_piece:
            return None
        shared = spark.sparkContext.broadcast((qids, q, {p: np.array(v) for p, v in of_piece.items()}))

        def best(batches):
            qid, unit, mine = shared.value
            for pdf in batches:
                for p, g in pdf.groupby("piece"):
                    if p in mine:
                        yield _best(qid[mine[p]], unit[mine[p]], g["node_id"].to_numpy(), np.stack(g["vector"].to_numpy()), k, None)

        return vectors.where(F.col("piece").isin([*of_piece])).select("piece", "node_id", "vector").mapInPandas(best, "query_id long, node_id long, score double")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= k)
    near = checkpointed(ranked(scan(first)), "near")
    least = {r["query_id"]: (r["n"], r["s"]) for r in near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()}  # one number a query
    reach = np.array([least[i][1] if i in least and least[i][0] >= k else -np.inf for i in qids.tolist()])
    rest = ~first & (bounds >= reach[:, None] - _SLACK)
    more = scan(rest)
    hits = near.drop("rank") if more is None else near.drop("rank").unionByName(more)
    return Found(ranked(hits).select("query_id", "rank", "node_id", "score"), int((first | rest).any(0).sum()), len(known))
