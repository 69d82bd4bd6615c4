"""Set-similarity join of documents on word shingles, with adaptive multi-match prefixes.

Every document is the set of its distinct n-word shingles (64-bit hashes). All sets are sorted by one
global order, rare shingles first; the rarity comes from a count sketch of fixed size that covers the
whole corpus, so it steers cost but never the result. In that order two sets with the required overlap
share at least l shingles among the first ``size - required + l`` of each. Each document picks the l
for which its posting scans plus the expected number of candidates to verify is least: a longer prefix,
more shared shingles asked. A pair is a candidate when it shares min(l of both) prefix shingles and
the positions of the first shared one leave enough room; candidates are verified on whole texts.

Nothing grows with the square of a group. Equal sets are collapsed first. Then every prefix shingle
sends its documents to one hub (the member whose prefix is the most frequent, as the text from which
the others were edited is), which is linear; the verified links give components, and only shingles
that still hold several components are joined pairwise, under the position bound, in tiles of bounded size:
postings meet without their sets, and how many shingles a pair shares is counted. So no pair within a component already found is ever listed, and none between components is missed. For
verification the text of a pair's better connected side travels once per block of its partners.

Defined cases: null or wordless texts have an empty set and are linked with nothing; texts shorter than
n words are one shingle, their whole sequence; rows with a null doc_id get a null component. doc_id is
the key: rows that repeat one are the same document; if their texts differ, each row is matched by its own
text and has its own n_shingles, and what any of them is linked with is one component. A very long text is
one set like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.llm._common import components, dropped, ranked, released, stored

#: log2 of the sketch's counters; its size (16 MB) doesn't depend on the corpus.
SKETCH_BITS = 22
#: Largest number of ids that is broadcast (8 MB); larger sets are joined by shuffle.
BROADCAST_IDS = 1_000_000
MAX_MATCH = 3
#: Shingles of so many documents always ask their hub, as among them listing pairs would cost most.
LARGE = 16
#: Postings of a side of a tile where open shingles are joined, and partners that share one copy of a text.
TILE = 10_000
BLOCK = 256
_CHUNK = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Words(dict):
    """Hash of each word; forgets everything when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def forget() -> None:
    """At the end of a task: words aren't needed in what comes next."""
    _words.clear()
    released()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's n-word shingles, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = (acc + h[i : len(h) - k + 1 + i]) * _MIX[0]
        acc ^= acc >> np.uint64(31)
    return np.unique(_mixed(acc))


def required(size: int, percent: int) -> int:
    """The least overlap with any set that a set of this size can be linked by."""
    return -(-percent * size // 100)


class Order:
    """The global order of shingles: class of estimated frequency, then hash."""

    def __init__(self, counters: np.ndarray, documents: int):
        self.counters, self.documents = counters, max(documents, 1)
        self.load = float(counters.sum()) / len(counters)

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        """Estimated number of documents, at least 1; what collisions add on average is taken off."""
        return np.maximum(self.counters[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] - self.load, 1.0)

    def prefix(self, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int, float]:
        """The prefix in order, the number of matches it asks, and its mean frequency."""
        df = self.frequency(tokens)
        noise = 2 * np.sqrt(self.load) + 1
        rank = np.where(df <= noise, 0, np.floor(1.5 * np.log2(df)) + 1).astype(np.uint64)
        order = np.argsort((rank << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")
        base = len(tokens) - required(len(tokens), percent)
        best = (np.inf, 1)
        for ell in range(1, MAX_MATCH + 1):
            if base + ell > len(tokens):
                break
            scans = float(df[order[: base + ell]].sum())
            rate, term, below = scans / self.documents, 1.0, 0.0
            for i in range(ell):
                below += term
                term *= rate / (i + 1)
            candidates = self.documents * max(0.0, 1 - np.exp(-rate) * below)
            best = min(best, (scans + 8 * candidates, ell))
        ell = best[1]
        return tokens[order[: base + ell]], ell, float(df[order[: base + 1]].mean())


def _sketch(docs: DataFrame, n: int) -> Order:
    """Count shingles of all documents into counters of fixed number; partial sketches meet in two levels."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total, rows, waiting, held = np.zeros(size, np.uint32), 0, [], 0

        def add():
            np.add(total, np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32), out=total)
            waiting.clear()

        for pdf in batches:
            rows += len(pdf)
            for text in pdf["text"]:
                t = (shingles(text, n) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                waiting.append(t)
                held += len(t)
                if held > 1_000_000:
                    add()
                    held = 0
        if waiting:
            add()
        if rows:
            salt = int(total[:4096].sum()) % 16
            yield pd.DataFrame({
                "chunk": range(size // _CHUNK), "salt": salt, "rows": [rows] + [0] * (size // _CHUNK - 1),
                "counts": [zlib.compress(np.minimum(total[k : k + _CHUNK], 65535).astype(np.uint16).tobytes(), 1) for k in range(0, size, _CHUNK)],
            })

    def merged(kind):
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(_CHUNK, np.uint64)
            for c in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(c), kind)
            return pd.DataFrame({"chunk": [pdf["chunk"][0]], "rows": [pdf["rows"].sum()], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

        return merge

    schema = "chunk int, rows long, counts binary"
    parts = docs.select("text").mapInPandas(count, "chunk int, salt int, rows long, counts binary")
    once = parts.groupBy("chunk", "salt").applyInPandas(merged(np.uint16), schema)
    found = once.groupBy("chunk").applyInPandas(merged(np.uint32), schema).collect()
    counters = np.zeros(size, np.uint32)
    for r in found:
        counters[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return Order(counters, sum(r["rows"] for r in found))


def _room(p: int, n1, pos1, n2, pos2):
    """Whether sets of n1 and n2 that first share the shingles at pos1 and pos2 can still be similar."""
    most = F.least(n1 - pos1, n2 - pos2)
    return most * 100 >= (n1 + n2 - most) * p


def _met(batches, percent: int):
    """Pairs of different components that meet on postings sorted by (tile, tok): how often (a, b, k) and how many they need (ell).

    A pair that can be similar has room at each of its first ell shared shingles, the ones before counted in, so these are counted.
    """

    def pairs(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ell = np.minimum(x["ell"][i], x["ell"][j])
        most = np.minimum(x["n"][i] - x["pos"][i], x["n"][j] - x["pos"][j]) + ell - 1
        fit = most * 100 >= (x["n"][i] + x["n"][j] - most) * percent
        fit &= (x["comp"][i] != x["comp"][j]) & ((x["t1"][i] == x["t2"][i]) | (x["own"][i] != x["own"][j]))
        a, b = x["rep"][i][fit], x["rep"][j][fit]
        return np.stack([np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), ell[fit]])

    def summed(found: list[np.ndarray]) -> pd.DataFrame:
        a, b, k, ell = np.concatenate(found, 1)
        order = np.lexsort((b, a))
        a, b, k, ell = a[order], b[order], k[order], ell[order]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        return pd.DataFrame({"a": a[at], "b": b[at], "k": np.add.reduceat(k, at) if len(a) else k, "ell": ell[at].astype(np.int32)})

    def groups(x: dict[str, np.ndarray]):
        """Pairs of each group, found by size: a larger set's position leaves a range of sizes for the smaller one."""
        fresh = np.append(True, (x["tok"][1:] != x["tok"][:-1]) | (x["t1"][1:] != x["t1"][:-1]) | (x["t2"][1:] != x["t2"][:-1]))
        group = np.cumsum(fresh) - 1
        order = np.lexsort((x["n"], group))
        x = {c: v[order] for c, v in x.items()}
        n, base = x["n"], group * (int(x["n"].max()) + 2)
        most = n - x["pos"] + x["ell"] - 1
        low = np.searchsorted(base + n, base + -(-n * percent // 100))
        high = np.searchsorted(base + n, base + np.clip(most * (100 + percent) // percent - n, -1, n), "right")
        many = np.maximum(np.minimum(high, np.arange(len(n))) - low, 0)
        ends = np.cumsum(many)
        i = 0
        while i < len(n):  # so many pairs at once, or one posting's
            before = ends[i] - many[i]
            j = max(i + 1, int(np.searchsorted(ends, before + 250_000, "right")))
            larger = np.repeat(np.arange(i, j), many[i:j])
            yield pairs(x, larger, low[larger] + np.arange(len(larger)) - (ends[larger] - many[larger] - before))
            i = j

    rest, found, held = None, [], 0
    for pdf in batches:
        x = {c: pdf[c].to_numpy(np.int64) for c in pdf.columns}
        x = x if rest is None else {c: np.concatenate([rest[c], x[c]]) for c in x}
        last = (x["tok"] == x["tok"][-1:]) & (x["t1"] == x["t1"][-1:]) & (x["t2"] == x["t2"][-1:])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # where the last group begins
        rest = {c: v[cut:] for c, v in x.items()}
        for part in groups({c: v[:cut] for c, v in x.items()}) if cut else ():
            found.append(part)
            held += part.shape[1]
            if held > 250_000:
                yield summed(found)
                found, held = [], 0
    for part in groups(rest) if rest is not None and len(rest["tok"]) else ():
        found.append(part)
        held += part.shape[1]
        if held > 250_000:
            yield summed(found)
            found, held = [], 0
    if found:
        yield summed(found)


def _small(rows: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has no more than BROADCAST_IDS rows of a few numbers."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole texts have the similarity.

    The side with more pairs is the center: its text goes once to each block of at most BLOCK partners or so,
    with theirs, and a task reads block by block.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs"))
    ids = stored(ends, "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = F.broadcast(ids) if few else ids
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(side.select("id"), "id"), "texts")
    known = lambda c: side.select(F.col("id").alias(c), F.col("pairs").alias(f"{c}_pairs"))
    swap = F.col("b_pairs") > F.col("a_pairs")
    placed = (
        pairs.join(known("a"), "a").join(known("b"), "b")
        .select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("center"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("id"), F.greatest("a_pairs", "b_pairs").alias("most"))
        .select("center", F.pmod(F.xxhash64("id"), F.ceil(F.col("most") / BLOCK)).cast("int").alias("block"), "id")
    )
    placed = stored(placed, "placed")
    whole = stored(placed.select("center", "block").distinct(), "whole")
    partners = texts.join(_small(placed), "id").select("center", "block", "id", "text")
    centers = texts.withColumnRenamed("id", "center").join(_small(whole), "center")
    both = partners.unionByName(centers.select("center", "block", F.lit(None).cast("long").alias("id"), "text"))
    blocks = both.repartition("center", "block").sortWithinPartitions("center", "block", F.col("id").asc_nulls_first())

    def check(batches):
        center, x = None, np.zeros(0, np.uint64)
        sets: dict[int, np.ndarray] = {}
        for pdf in batches:
            found = []
            for c, k, t in zip(pdf["center"], pdf["id"], pdf["text"]):
                if k != k or k is None:  # the center's own row comes first
                    center, x = c, shingles(t, n)
                    continue
                if len(sets) > 64:
                    sets.clear()
                k = int(k)
                if k not in sets:
                    sets[k] = shingles(t, n)
                y = sets[k]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    found.append((min(center, k), max(center, k)))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        sets.clear()
        forget()

    out = stored(blocks.mapInPandas(check, "a long, b long"), "links")
    dropped(ids, texts, placed, whole)
    return out


def _apart(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """doc_id, text and key: the doc_id, but for rows of the bad ids a number below all ids for each (doc_id, text)."""
    low = docs.agg(F.min("doc_id")).first()[0]
    rest = docs.join(bad, "doc_id", "left_anti").withColumn("key", F.col("doc_id"))
    mine = docs.join(bad, "doc_id")
    texts = ranked(stored(mine.distinct(), "texts"), [], ["doc_id", "text"], "rank").select("doc_id", F.col("text").alias("own"), (F.lit(low - 1) - F.col("rank")).alias("key"))
    return rest.unionByName(mine.join(texts, "doc_id").where(F.col("text").eqNullSafe(F.col("own"))).drop("own"))


def join_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; linked when 100 * shared >= percent * united."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).where("x <> y").select("doc_id")
    bad = stored(several, "several")
    if not bad.limit(1).count():
        return _joined(docs, n, percent)
    keyed = stored(_apart(docs, bad), "keyed")
    got = _joined(keyed.select(F.col("key").alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("label"))
    rows = stored(keyed.select("doc_id", "key").join(got.where("key is not null").distinct(), "key", "left"), "rows")
    least = rows.join(bad, "doc_id").groupBy("doc_id").agg(F.min("label").alias("a"))
    merged = components(rows.join(least, "doc_id").select("a", F.col("label").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    full = stored(rows.join(merged, "label", "left").withColumn("whole", F.coalesce("whole", "label")), "full")
    first = full.where("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    out = stored(full.join(first, "whole", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id"), "classes")
    nulls = got.where("key is null").select(F.col("key").alias("doc_id"), "n_shingles", F.col("label").alias("component_id"))
    out = out.where("doc_id is not null").unionByName(nulls)
    dropped(keyed, rows, full, bad)
    return out


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """join_components() where all rows of a doc_id have one text."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_sketch(docs, n))

    def describe(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                t = shingles(text, n)
                if not len(t):
                    rows.append((doc_id, 0, 0, 0, 0, 0.0, []))
                    continue
                pre, ell, mean = order.value.prefix(t, percent)
                f1, f2 = np.array([t.sum(), _mixed(t ^ _MIX[2]).sum()], np.uint64).view(np.int64)
                rows.append((doc_id, len(t), f1, f2, ell, mean, pre.view(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "f1", "f2", "ell", "mean", "pre"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        forget()

    sets = stored(docs.mapInPandas(describe, "doc_id long, n long, f1 long, f2 long, ell int, mean double, pre array<long>"), "sets")
    same = ["f1", "f2", "n"]
    groups = stored(sets.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "groups")
    copies = sets.select("doc_id", *same).join(groups, same).where("doc_id <> rep").select("doc_id").distinct()
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    reps = sets.where("n > 0 and doc_id is not null").join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    reps = reps.select(F.col("doc_id").alias("rep"), "n", "ell", "mean", "pre")
    posts = reps.select("rep", F.posexplode("pre").alias("pos", "tok"))
    shared = stored(posts.groupBy("tok").count().where("count > 1").select("tok"), "shared")
    common = stored(posts.join(shared, "tok"), "common")
    live = stored(common.join(reps.select("rep", "n", "ell", "mean"), "rep").distinct(), "live")

    hubs = stored(
        live.groupBy("tok").agg(F.max_by(F.struct("rep", "n", "pos", "ell"), F.struct(F.col("mean"), -F.col("rep"))).alias("h"), F.count("*").alias("size")), "hubs"
    )
    near = live.join(hubs, "tok").where(F.col("rep") != F.col("h.rep")).where(_room(percent, F.col("n"), F.col("pos"), F.col("h.n"), F.col("h.pos")))
    asked = near.groupBy(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("ell", "h.ell")).alias("m"), F.max("size").alias("size"))
    first = stored(asked.where((F.col("k") >= F.col("m")) | (F.col("size") >= LARGE)).select("a", "b"), "pairs")
    links = _verified(first, docs, n, percent)
    found = stored(components(links), "components")

    # What is still open: postings with a partner of another component whose size leaves room at this position.
    t = percent / 100
    kind = lambda c: F.floor(F.log(c + 1e-9) / float(np.log(1 / t))).cast("int")
    placed = stored(
        live.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("tok", "rep", "n", "ell", "pos", F.coalesce("label", "rep").alias("comp")),
        "placed",
    )
    kinds = stored(placed.groupBy("tok", kind(F.col("n")).alias("kind")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")), "kinds")
    # Up to ell - 1 shared shingles may lie before this one and count in the overlap.
    most = F.least(F.col("n") / t, (F.col("n") - F.greatest(F.col("pos") - F.col("ell") + 1, F.lit(0))) * (1 + t) / t - F.col("n"))
    reach = placed.withColumn("lo", kind(F.ceil(F.col("n") * t - 1e-6))).withColumn("hi", kind(F.floor(most + 1e-6))).where("hi >= lo")
    partners = reach.withColumn("kind", F.explode(F.sequence("lo", "hi"))).join(kinds, ["tok", "kind"]).where("x <> comp or y <> comp")
    # Shingles of one family of texts mostly have one hub: dealt by it, a pair meets on all of them in one task.
    family = hubs.select("tok", F.col("h.rep").alias("family"))
    open_ = stored(partners.select(*placed.columns).distinct().join(family, "tok"), "open")
    # Few shingles need more than one block, so their number is joined without moving the postings.
    many = stored(open_.groupBy("tok").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")).where("blocks > 1"), "many")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = open_.join(_small(many), "tok", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Blocks meet in tiles: rows of one block in the tile (i, i), those of two in the tile (i, j).
    tiles = rows.withColumn("far", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("t1", F.least("own", "far")).withColumn("t2", F.greatest("own", "far"))
    dealt = tiles.withColumn("part", F.pmod(F.xxhash64("tok"), F.col("blocks"))).repartition("family", "t1", "t2", "part")
    dealt = dealt.sortWithinPartitions("family", "t1", "t2", "tok").select("tok", "t1", "t2", "own", "rep", "comp", "n", "pos", "ell")
    met = dealt.mapInPandas(lambda batches: _met(batches, percent), "a long, b long, k long, ell int")
    cross = met.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("ell").alias("ell")).where("k >= ell").select("a", "b").join(first, ["a", "b"], "left_anti")
    second = stored(cross, "cross")
    if second.limit(1).count():
        more = _verified(second, docs, n, percent)
        found2 = stored(components(links.unionByName(more)), "components")
        dropped(found, more)
        found = found2
    member = sets.select("doc_id", *same).join(groups, same, "left")
    labelled = member.join(found, member["rep"] == found["node"], "left")
    out = labelled.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"),
    )
    out = stored(out, "classes")
    dropped(sets, groups, shared, common, live, hubs, first, links, found, placed, kinds, open_, many, second)
    return out


def keep_firsts(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns.

    The ids that go are broadcast while they are few (BROADCAST_IDS), else joined by shuffle. Of rows that
    repeat a doc_id the one with the least text stays; rows with a null doc_id all stay.
    """
    found = stored(join_components(docs, n, percent), "classes")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = kept.where("doc_id is not null").select("*", nth.alias("_nth")).where("_nth = 1").drop("_nth")
    return one.unionByName(kept.where("doc_id is null"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for 3-word shingles and a Jaccard similarity of 0.9."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


#: The same rows in SQL: all pairs that share a shingle, then everything that can be reached.
OP2_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words
), items as (
  select doc_id, len(s) as n, hash(unnest(s)) as g from sets
), pairs as (
  select a.doc_id as a, b.doc_id as b, a.n + b.n as n, count(*) as k from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs where 100 * k >= 90 * (n - k) union all select b, a from pairs where 100 * k >= 90 * (n - k)
), reached(doc_id, other) as (
  select doc_id, doc_id from sets union select r.doc_id, l.b from reached r join links l on l.a = r.other
)
select doc_id, len(s)::bigint as n_shingles, c.component_id from sets join (select doc_id, min(other) as component_id from reached group by doc_id) c using (doc_id)
"""
