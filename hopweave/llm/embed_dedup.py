"""Embedding near-dedup by product quantisation: inverted lists, residual codes, exact cosine rerank.

Equal vectors of a label are one node with a weight. Vectors are scaled to length one, so cosine >= t means
a distance of at most r = sqrt(2 - 2t). A coarse quantiser deals them to inverted lists, and the residuals
are coded by one small codebook per subspace; both are fitted on a bounded, documented sample, every vector
is indexed. The number of lists grows with the square root of the number of nodes.

A vector probes every list whose border is within ``spread * r / sqrt(d)`` of it, and never beyond r, which
is the exact bound of a Voronoi cell. Two copies that differ by noise lie on both sides of a border so far
off only if the noise is ``spread`` standard deviations along that one direction; a pair is found if either
of its vectors probes the other's list. ``spread=inf`` (or at least sqrt(d)) probes by the exact bound, and
then no link can be missed. Within a list, table look-ups give the distance from the query to each code; as
each code's own error is stored, the triangle inequality keeps every true partner there, and the few that
pass are judged by exact cosine in double precision.

Lists are cut into tiles of (query block x index block) of bounded size, so a hot label or list is worked on
by many tasks. A tile returns each node's number of links and a spanning forest of the links it found,
never the pairs; counts are summed and forests joined into components by contraction. A pair that both
its vectors find counts once for each, one that only one finds counts for both there and then.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing: n_links 0 and their own component. Vectors of different length never link.
Null vec_ids keep a null component. vec_id is the key: repeated rows with one vec_id are one vector, the
least of its (label, embedding). Each row of the input has a row in the result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import components, dropped, stored
from hopweave.llm.vectors import kmeans, usable

#: Rows of the sample on which the quantisers are fitted; least and most lists, subspaces and codes in each.
SAMPLE = 20_000
LISTS = (16, 2048)
SUBSPACES = 8
CODES = 64
#: Standard deviations of an isotropic displacement that a probe allows for.
SPREAD = 4.0
#: Groups of equal vectors that are broadcast (some 50 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Rows of a tile's side.
TILE = 2_000
#: Vectors dealt to their lists at once.
DEALT = 250


class Quantiser:
    """Coarse centroids and, per subspace of the residuals, a codebook. Made for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        self.coarse = kmeans(sample, lists, 1)
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        near, _ = self.nearest(sample)
        rest = sample - self.coarse[near]
        self.books = [kmeans(rest[:, c], codes, 2 + i) for i, c in enumerate(self.cuts)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)
        return d.argmin(1), d

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "between"}

    def probes(self, d: np.ndarray, near: np.ndarray, margin: float) -> np.ndarray:
        """True for the lists to whose border (the bisector) the query is within the margin, its own among them."""
        if "between" not in self.__dict__:  # made by each worker, not sent
            squares = (self.coarse**2).sum(1)
            apart = squares[:, None] - 2 * self.coarse @ self.coarse.T + squares
            self.between = np.sqrt(np.maximum(apart, 1e-12)).astype(np.float32)
        own = d[np.arange(len(d)), near]
        return (d - own[:, None]) / (2 * self.between[near]) <= margin + 1e-6

    def coded(self, x: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the error of each."""
        rest = x - self.coarse[cell]
        codes = np.stack([(-2 * rest[:, c] @ b.T + (b**2).sum(1)).argmin(1) for c, b in zip(self.cuts, self.books)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest[:, np.concatenate(self.cuts)] - back) ** 2).sum(1))

    def distances(self, q: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Asymmetric distances from queries to codes, by table look-up."""
        rest = q - self.coarse[cell]
        total = np.zeros((len(q), len(codes)))
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            table = (rest[:, c] ** 2).sum(1)[:, None] - 2 * rest[:, c] @ b.T + (b**2).sum(1)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the graph with edges a-b: each node with the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(
    vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE, lists: int | None = None, subspaces: int = SUBSPACES, codes: int = CODES, tile: int = TILE, spread: float = SPREAD
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")), "vectors")
    part = rows.where("vec_id is not null and label is not null and embedding is not null")
    part = part.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("s")).select("vec_id", "s.*")

    def unit(batches):
        for pdf in batches:
            for _, g in pdf.groupby(pdf["embedding"].map(len)):
                at, x = usable(g["embedding"])
                if len(at):
                    g = g.iloc[at]
                    yield pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "dim": x.shape[1], "v": [*x]})

    same = ["dim", "label", "h", "h2"]
    hashes = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("h2")]
    units = stored(part.mapInPandas(unit, "vec_id long, label string, dim int, v array<double>").select("*", *hashes), "units")
    nodes = stored(units.groupBy(*same).agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("v").alias("v")), "nodes")
    count = nodes.count()
    lists = lists or int(np.clip(np.sqrt(count), *LISTS))
    first = nodes.orderBy(F.xxhash64("node")).limit(sample).select("dim", "v").toPandas()  # bounded by sample
    fitted = {}
    for d, g in first.groupby("dim"):
        if len(g) > 1:
            x = np.stack(g["v"].to_numpy())
            fitted[int(d)] = Quantiser(x / np.sqrt((x**2).sum(1))[:, None], lists, subspaces, codes)
    model = spark.sparkContext.broadcast(fitted)

    def deal(batches):
        columns = ["dim", "label", "cell", "is_query", "node", "weight", "v", "home", "asked"]
        for pdf in batches:
            for dim, every in pdf.groupby("dim"):
                q = model.value.get(int(dim))
                for s in range(0, len(every), DEALT):  # a vector may go to many lists
                    g = every.iloc[s : s + DEALT]
                    if q is None:
                        yield pd.concat([g.assign(cell=0, home=0, is_query=own, asked=[[0]] * len(g)) for own in (True, False)])[columns]
                        continue
                    v = np.stack(g["v"].to_numpy())
                    near, d = q.nearest(v / np.sqrt((v**2).sum(1))[:, None])
                    i, cell = np.nonzero(q.probes(d, near, min(radius, spread * radius / np.sqrt(dim))))
                    asked = np.split(cell.astype("int32"), np.searchsorted(i, np.arange(1, len(g))))
                    g = g.assign(home=near)
                    yield pd.concat([g.assign(cell=near, is_query=False, asked=asked), g.iloc[i].assign(cell=cell, is_query=True, asked=None)])[columns]

    dealt = stored(nodes.select("dim", "label", "node", "weight", "v").mapInPandas(deal, "dim int, label string, cell int, is_query boolean, node long, weight long, v array<double>, home int, asked array<int>"), "dealt")
    key = ["dim", "label", "cell"]
    sizes = dealt.groupBy(*key).agg(F.ceil(F.count_if(F.col("is_query")) / tile).cast("int").alias("nq"), F.ceil(F.count_if(~F.col("is_query")) / tile).cast("int").alias("ni"))
    sizes = stored(sizes.where("nq > 0 and ni > 0"), "sizes")
    salted = dealt.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_query"), F.col("nq")).otherwise(F.col("ni"))).cast("int"))
    other = F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("ni")).otherwise(F.col("nq")) - 1)
    carried = ["is_query", "node", "weight", "v", "home", "asked"]
    tiled = salted.select(*key, *carried, "own", F.explode(other).alias("far")).select(
        *key, F.when(F.col("is_query"), F.col("own")).otherwise(F.col("far")).alias("tq"), F.when(F.col("is_query"), F.col("far")).otherwise(F.col("own")).alias("ti"), *carried
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, index = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        if not len(queries) or not len(index):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        cell, quantiser = int(pdf["cell"].iloc[0]), model.value.get(int(pdf["dim"].iloc[0]))
        v = np.stack(index["v"].to_numpy())
        ids, qids = index["node"].to_numpy(), queries["node"].to_numpy()
        asked, home, weight, own_weight = index["asked"].tolist(), queries["home"].to_numpy(), index["weight"].to_numpy(), queries["weight"].to_numpy()
        norms = np.sqrt((v**2).sum(1))
        x = v / norms[:, None]
        codes, error = quantiser.coded(x, cell) if quantiser else (None, None)
        left, right, counts, back = [], [], np.zeros(len(qids), np.int64), np.zeros(len(ids), np.int64)
        for s in range(0, len(qids), 256):
            w = np.stack(queries["v"].iloc[s : s + 256].to_numpy())
            own = np.sqrt((w**2).sum(1))
            q = w / own[:, None]
            close = quantiser.distances(q, codes, cell) <= radius + error + 1e-7 if quantiser else np.ones((len(q), len(x)), bool)
            i, j = np.nonzero(close)
            for k in range(0, len(i), 20_000):
                a, b = i[k : k + 20_000], j[k : k + 20_000]
                cosine = np.einsum("ij,ij->i", w[a], v[b]) / (own[a] * norms[b])
                good = (cosine >= threshold) & (qids[s + a] != ids[b])
                a, b = s + a[good], b[good]
                np.add.at(counts, a, weight[b])
                left.append(qids[a])
                right.append(ids[b])
                # What the other vector doesn't find by its own probes counts for it here.
                alone = np.array([h != cell and h not in asked[t] for h, t in zip(home[a], b)], bool)
                np.add.at(back, b[alone], own_weight[a[alone]])
        a, b = _forest(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
        counted = pd.DataFrame({"a": [*qids[counts > 0], *ids[back > 0]], "n": [*counts[counts > 0], *back[back > 0]]})
        return pd.concat([counted, pd.DataFrame({"a": a, "b": b, "n": 0})]).reindex(columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    found = stored(tiled.groupBy(*key, "tq", "ti").applyInPandas(compare, "a long, b long, n long"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b"))
    groups = nodes.where("weight > 1").select(*same, F.col("node").alias("rep"), "weight")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    members = units.join(F.broadcast(groups) if few else groups, same, "left").select("vec_id", F.coalesce("rep", "vec_id").alias("node"), F.coalesce("weight", F.lit(1)).alias("weight"))
    known = members.join(counts, "node", "left").join(labels, "node", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id")
    )
    out = rows.select("vec_id").join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = stored(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), "classes")
    dropped(rows, units, nodes, dealt, sizes, found)
    return out


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 and more between vectors of one label, and their components."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: The same rows in SQL: all pairs of a label, then everything that can be reached.
OP4_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings where label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98
), reached(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reached r join links l on l.a = r.other
), n as (
  select a as vec_id, count(*) as n from links group by a
)
select vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, vec_id = c.component_id as kept
from (select vec_id, min(other) as component_id from reached group by vec_id) c left join n using (vec_id)
"""
