"""Nearest neighbours by vantage-point trees, one per shard, exact at a factor of one.

The largest inner product becomes the least Euclidean distance once every vector is given one more
coordinate that lifts its length to the largest length M of its shard (queries get 0 there). Vectors near
one of the centers fitted on a bounded sample, and of about one length, form a shard; every row is
indexed, and each shard's tree is grown once: a vantage point, the median distance to it, an inner and an
outer half. A shard is also a ball. Each query first searches the shard whose center gives the largest
product; its k-th best value there then prunes all balls that the triangle inequality shows to hold
nothing better, and only to the rest is the query dealt. In a tree all queries of a block descend together,
nearer side first, with the k-th best value so far. A side or a ball is pruned when its least possible
distance, times the relaxation factor, exceeds the query's current radius: a factor above one prunes more
and may miss; one is exact. Distances only prune, with room for their rounding; rows are ranked by inner
products of the original vectors in double precision, and every row within rounding of the k-th is scored
anew, however many there are, so long vectors take no precision from short ones.

What balls prune depends on the data: among unrelated directions of 64 dimensions nothing can be pruned
exactly, and every query meets every shard; among clusters it meets the few it lies near. Shards are dealt
to blocks of queries, so nothing is broadcast that grows but the balls, of which there are at most
CELLS * CLASSES and the parts that crowded cells are split in. Of equal vectors only the k + 1 smallest ids
can be among anyone's k nearest, so a tree holds no more of them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id, nor queries with no candidate of their length; repeated rows with one id are one
vector, the least. With fewer candidates than k, all are returned. Equal scores go to the smaller id. Vectors
of very different length fall into different shards and change no precision. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopweave.llm._common import dropped, stored
from hopweave.llm.vectors import kmeans, usable

#: Rows of a shard (more where CELLS would not do), queries of a block, rows of a leaf.
SHARD_ROWS = 6_000
BLOCK_ROWS = 3_000
LEAF = 256
#: Rows of the sample for the centers, most centers, and classes of length (each a factor of eight, the ends open).
SAMPLE = 20_000
CELLS = 4_096
CLASSES = 9
#: Numbers gathered at once when candidates are scored anew; twice the spacing of doubles at one.
GATHER = 4_000_000
EPS = 2.0**-51


class Tree:
    """A vantage-point tree over the rows of x, by Euclidean distance or, if lifted, by inner product."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, lifted: bool = False):
        self.leaf, self.lifted = leaf, lifted
        self._prepare(x)
        self.root = self._grow(np.arange(len(x)), np.random.default_rng(7))

    def _prepare(self, x: np.ndarray) -> None:
        self.x, lifted = x, self.lifted
        squares = (x**2).sum(1)
        self.longest = squares.max(initial=0)
        self.points = np.concatenate([x, np.sqrt(np.maximum(self.longest - squares, 0))[:, None]], 1) if lifted else x
        # A squared distance is the query's square plus base minus twice the value (product less shift) of the row.
        self.base, self.shift = (self.longest, np.zeros(len(x))) if lifted else (0.0, squares / 2)
        self.lengths = np.sqrt(squares)

    def packed(self) -> bytes:
        """The rows and the structure; all else follows from them."""
        return pickle.dumps((self.x, self.leaf, self.lifted, self.root), protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        x, leaf, lifted, root = pickle.loads(raw)
        tree = cls(x[:0], leaf, lifted)
        cls._prepare(tree, x)
        tree.root = root
        return tree

    def ball(self) -> tuple[np.ndarray, float]:
        """Center and radius around the points, lifted or not."""
        center = self.points.mean(0)
        return center, float(np.sqrt(((self.points - center) ** 2).sum(1).max(initial=0)) * (1 + 1e-9))

    def _grow(self, at: np.ndarray, rng) -> tuple:
        if len(at) <= self.leaf:
            return ("leaf", at)
        k = rng.integers(len(at))
        point, rest = at[k], np.delete(at, k)
        d = np.sqrt(((self.points[rest] - self.points[point]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        inner, outer = rest[order[:half]], rest[order[half:]]
        return ("node", point, float(d[order[half - 1]]), float(d[order[half]]), self._grow(inner, rng), self._grow(outer, rng))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances (lifted: negative inner products) and rows of each query's k nearest; ties to the lower row.

        (inf, -1) where there are fewer. With a floor (the value of a k-th best elsewhere), what is surely
        below it may be missing. Values of blocks are bracketed by their rounding: the k-th largest lower
        end is the floor, and all rows whose upper end reaches it are candidates, scored row by row at the end.
        """
        squares = (queries**2).sum(1)
        lengths, unit = np.sqrt(squares), (queries.shape[1] + 8) * EPS
        asks = np.concatenate([queries, np.zeros((len(queries), 1))], 1) if self.lifted else queries
        room = 8 * unit * (squares + self.longest)
        best = np.full((len(queries), k), -np.inf)
        if floor is not None:
            best[:] = (floor - 2 * unit * lengths * self.lengths.max(initial=0))[:, None]
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def offer(who: np.ndarray, at: np.ndarray) -> None:
            values = queries[who] @ self.x[at].T - self.shift[at]
            wide = 2 * unit * (lengths[who, None] * self.lengths[at] + self.shift[at])
            lows = values - wide
            more = np.nonzero(lows.max(1) > best[who, -1])[0]
            if len(more):
                got = lows[more]
                if got.shape[1] > k:
                    got = np.partition(got, got.shape[1] - k, 1)[:, -k:]
                best[who[more]] = -np.sort(-np.concatenate([best[who[more]], got], 1), 1)[:, :k]
            highs = values + wide
            i, j = np.nonzero(highs >= best[who, -1:])
            if len(i):
                kept.append((who[i], at[j], highs[i, j]))

        def visit(node: tuple, who: np.ndarray) -> None:
            if node[0] == "leaf":
                offer(who, node[1])
                return
            _, point, low, high, inner, outer = node
            offer(who, np.array([point]))
            d = np.sqrt(((asks[who] - self.points[point]) ** 2).sum(1))
            near, blur = d <= (low + high) / 2, unit * (d + high)

            def pruned(mask: np.ndarray, bound: np.ndarray) -> np.ndarray:
                radius = squares[who] + self.base - 2 * best[who, -1] + room[who]
                return who[mask & ((factor * np.maximum(bound - blur, 0)) ** 2 <= radius)]

            for first in (True, False):
                for side, bound, mine in ((inner, d - low, near), (outer, high - d, ~near)):
                    go = pruned(mine == first, bound)
                    if len(go):
                        visit(side, go)

        far, rows = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
        if not len(queries) or not len(self.x):
            return far, rows
        visit(self.root, np.arange(len(queries)))
        if not kept:
            return far, rows
        who, at, highs = (np.concatenate(c) for c in zip(*kept))
        still = highs >= best[who, -1]
        who, at = who[still], at[still]
        score, step = np.empty(len(who)), max(1, GATHER // self.x.shape[1])
        for s in range(0, len(who), step):
            q, x = queries[who[s : s + step]], self.x[at[s : s + step]]
            score[s : s + step] = -np.einsum("ij,ij->i", q, x) if self.lifted else ((q - x) ** 2).sum(1)
        order = np.lexsort((at, score, who))
        who, at, score = who[order], at[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        far[who[top], place[top]], rows[who[top], place[top]] = score[top], at[top]
        return far, rows


class Router:
    """The shards of vectors of one length: centers and a middle length to place rows by, and the balls once they are known."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.middle = float(np.median(np.sqrt((sample**2).sum(1))))
        self.centers = kmeans(sample, cells, 5)
        self.shards = np.zeros(0, np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        """cell * CLASSES + class of each row."""
        lengths = np.sqrt((x**2).sum(1))
        half = CLASSES // 2
        kind = np.clip(np.round(np.log2(lengths / self.middle) / 3), -half, half).astype(np.int64) + half
        scaled = x * (self.middle / lengths)[:, None]
        cell = (-2 * scaled @ self.centers.T + (self.centers**2).sum(1)).argmin(1)
        return cell * CLASSES + kind

    def learn(self, balls: list) -> None:
        """Rows with shard, center (lifted), radius and longest (squared)."""
        self.shards = np.array([b["shard"] for b in balls])
        self.balls = np.array([b["center"] for b in balls])
        self.radius, self.longest = np.array([b["radius"] for b in balls]), np.array([b["longest"] for b in balls])

    def first(self, q: np.ndarray) -> np.ndarray:
        """The position of the shard with the largest product of center and query."""
        return (q @ self.balls[:, :-1].T).argmax(1)

    def open(self, q: np.ndarray, floor: np.ndarray, factor: float) -> np.ndarray:
        """True where a shard may hold a value above the floor (all that was searched so far), but for the first."""
        squares = (q**2).sum(1)[:, None]
        unit = (q.shape[1] + 8) * EPS
        apart = squares + (self.balls**2).sum(1) - 2 * q @ self.balls[:, :-1].T
        room = 8 * unit * (squares + self.longest)
        low = np.sqrt(np.maximum(apart - room, 0)) - self.radius
        out = (factor * np.maximum(low, 0)) ** 2 <= squares + self.longest - 2 * floor[:, None] + room
        out[np.arange(len(q)), self.first(q)] = False
        return out


def search(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product with each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def clean(batches):
        for pdf in batches:
            for _, g in pdf.groupby(pdf["embedding"].map(len)):
                at, x = usable(g["embedding"])
                if len(at):
                    yield pd.DataFrame({"vec_id": g["vec_id"].iloc[at], "dim": x.shape[1], "x": [*x]})

    good = rows.where("vec_id is not null and embedding is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    units = stored(good.mapInPandas(clean, "vec_id long, dim int, x array<double>"), "units")
    size = units.count()
    cells = int(np.clip(-(-size // shard_rows), 1, CELLS))
    most = max(shard_rows, -(-size // cells))
    first = units.orderBy(F.xxhash64("vec_id")).limit(sample).select("dim", "x").toPandas()  # bounded by sample
    routers = {int(d): Router(np.stack(g["x"].to_numpy()), cells) for d, g in first.groupby("dim")}
    placing = spark.sparkContext.broadcast(routers)

    def place(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                router = placing.value.get(int(dim))  # vectors of a length that the sample lacks share one shard
                yield g.assign(home=router.home(np.stack(g["x"].to_numpy())) if router else 0)

    equal = Window.partitionBy("dim", "x").orderBy("vec_id")
    index = units.select("*", F.row_number().over(equal).alias("nth")).where(F.col("nth") <= k + 1).drop("nth")
    placed = stored(index.mapInPandas(place, "vec_id long, dim int, x array<double>, home long"), "placed")
    counts = placed.groupBy("dim", "home").count().orderBy("dim", "home").collect()  # bounded by cells and classes
    shard, homes = 0, []
    for r in counts:
        parts = -(-r["count"] // (2 * most))
        homes.append((r["dim"], r["home"], shard, parts))
        shard += parts
    plan = spark.createDataFrame(homes, "dim int, home long, shard int, parts int")
    sharded = placed.join(F.broadcast(plan), ["dim", "home"]).select("dim", (F.col("shard") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        tree = Tree(np.stack(pdf["x"].to_numpy()), lifted=True)
        center, radius = tree.ball()
        raw = pickle.dumps((pdf["vec_id"].to_numpy(), tree.packed()), protocol=5)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "center": [center], "radius": [radius], "longest": [tree.longest], "tree": [raw]})

    trees = stored(sharded.groupBy("shard").applyInPandas(grow, "shard int, dim int, center array<double>, radius double, longest double, tree binary"), "trees")
    balls = trees.drop("tree").orderBy("shard").collect()  # one row per shard
    for d in {b["dim"] for b in balls}:
        mine = [b for b in balls if b["dim"] == d]
        routers.setdefault(d, Router(np.array([b["center"][:-1] for b in mine]), 1)).learn(mine)
    routing = spark.sparkContext.broadcast(routers)
    asked = units.where(F.pmod("vec_id", F.lit(every)) == 0)
    schema = "query_id long, vec_id long, score double"

    def hunt(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, raw = pickle.loads(held["tree"].iloc[0])
        tree, out = Tree.unpacked(raw), []
        asks, qids, floor = np.stack(queries["x"].to_numpy()), queries["vec_id"].to_numpy(), queries["floor"].to_numpy()
        for s in range(0, len(qids), 512):
            me = qids[s : s + 512]
            far, at = tree.search(asks[s : s + 512], k + 1, factor, floor[s : s + 512])  # one more: the query itself may be of the shard
            i, j = np.nonzero(at >= 0)
            got = pd.DataFrame({"query_id": me[i], "vec_id": ids[at[i, j]], "score": -far[i, j]})
            got = got[got["query_id"] != got["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(got.groupby("query_id").head(k))
        return pd.concat(out)

    def searched(dealt, name: str) -> DataFrame:
        """dealt(batches) gives the columns shard, vec_id, x, floor of query batches; shards meet blocks of their queries."""

        def tally(batches):
            for pdf in dealt(batches):
                n = pdf["shard"].value_counts()
                yield pd.DataFrame({"shard": n.index.astype("int32"), "n": n.to_numpy()})

        loads = source.mapInPandas(tally, "shard int, n long").groupBy("shard").agg(F.ceil(F.sum("n") / max(block_rows, most // 2)).cast("int").alias("blocks"))
        loads = spark.createDataFrame(loads.collect(), "shard int, blocks int")  # one row per shard
        blocks = source.mapInPandas(dealt, "shard int, vec_id long, x array<double>, floor double").join(F.broadcast(loads), "shard")
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        copies = trees.select("shard", "tree").join(F.broadcast(loads), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return stored(blocks.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(hunt, schema), name)

    def nearest(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                router, q = routing.value[int(dim)], np.stack(g["x"].to_numpy())
                yield pd.DataFrame({"shard": router.shards[router.first(q)], "vec_id": g["vec_id"], "x": g["x"], "floor": -np.inf})

    def others(batches):
        for pdf in batches:
            for dim, every_row in pdf.groupby("dim"):
                router = routing.value[int(dim)]
                for s in range(0, len(every_row), 200):  # a query may go to many shards
                    g = every_row.iloc[s : s + 200]
                    i, j = np.nonzero(router.open(np.stack(g["x"].to_numpy()), g["floor"].to_numpy(), factor))
                    yield pd.DataFrame({"shard": router.shards[j], "vec_id": g["vec_id"].to_numpy()[i], "x": g["x"].iloc[i], "floor": g["floor"].to_numpy()[i]})

    source = asked
    found = searched(nearest, "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ended = [units, placed, trees, found]
    if len(balls) > 1:
        kth = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        source = stored(asked.join(kth, "vec_id", "left").select("vec_id", "dim", "x", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "floors")
        rest = searched(others, "rest")
        ended += [source, rest]
        found = found.unionByName(rest)
    out = stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    dropped(*ended)
    return out


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of the largest inner product with each row whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
