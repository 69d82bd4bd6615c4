"""Sharding: vector bin packing of groups of equal texts, balancing bytes, tokens and rows jointly.

A group (all rows of one text) has a vector of bytes, words and rows. Groups fall into classes of nearly
equal vectors; from the heaviest class down, each group goes to the shard whose residual capacity has
the highest dot product with the group's vector (the lower shard of equals). As every group that a shard
takes lowers its product by the same step, the choices for a whole class are the highest values of one
falling sequence per shard, so they are found by a threshold and not one by one: any number of groups is
placed as if singly. The driver sees one row per class (bytes in steps of 2 %, words per byte and rows in
steps of 9 %: some ten thousand at most, whatever the corpus), and every group finds its shard by its rank
within its class.

The law is ``bytes``: shard sizes are near equal. A group stays whole unless it alone would fill nine
tenths of a shard; then (at most 36 groups) it is split by a hash of doc_id into the fewest such parts.
Words are runs of characters other than white space, counted over the whole text.

Defined cases: null and empty texts (size 1, no words) are one group; null doc_ids and repeated rows are
placed like any other, and slots among equal doc_ids are in any order; a very long text is one group like
any other; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import dropped, ranked, stored

SHARDS = 16
#: What a share of the bytes, tokens and rows weighs in the dot product; the law is kept in bytes.
WEIGHTS = np.array([2.0, 1.0, 1.0])


def taken(scores: np.ndarray, step: float, n: int) -> np.ndarray:
    """How often each score is the highest (the first of equals) in n choices that each lower the chosen one by step."""
    counts = np.zeros(len(scores), np.int64)
    if n > 4 * len(scores):
        # The level to which n choices lower the scores, less a few that are then chosen one by one.
        high = np.sort(scores)[::-1]
        levels = (np.cumsum(high) - (n - 2 * len(scores)) * step) / np.arange(1, len(scores) + 1)
        level = levels[np.flatnonzero(levels < high)[-1]]
        counts = np.maximum(np.floor((scores - level) / step), 0).astype(np.int64)
    for _ in range(n - int(counts.sum())):
        counts[int((scores - counts * step).argmax())] += 1
    return counts


def place(classes: list[tuple], shards: int, weights: np.ndarray = WEIGHTS) -> list[np.ndarray]:
    """For each class (groups, bytes, words, rows): how many of its groups each shard takes."""
    total = np.maximum(np.array([[c[1], c[2], c[3]] for c in classes], float).sum(0), 1)
    residual = np.ones((shards, 3)) / shards
    out: list[np.ndarray] = [np.zeros(0)] * len(classes)
    vectors = [np.array([c[1], c[2], c[3]], float) / c[0] / total for c in classes]
    for k in sorted(range(len(classes)), key=lambda k: (-vectors[k].max(), classes[k])):
        n, v = classes[k][0], vectors[k]
        out[k] = taken(residual @ (weights * v), float((weights * v) @ v), n)
        residual -= out[k][:, None] * v
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    made = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        ),
        "rows",
    )
    rows, key = made, ["h", "text_crc32", "size"]
    sums = [F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("r")]
    groups = rows.groupBy(*key).agg(*sums)
    total = rows.agg(*sums).first()
    big = groups.where((F.col("b") * shards > 0.9 * (total["b"] or 0)) | (F.col("r") * shards > 0.9 * total["r"])).where("r > 1").collect()
    part = F.lit(0)
    for g in big:  # at most 2 * shards / 0.9 groups
        parts = int(np.ceil(max(g["b"] / total["b"], g["r"] / total["r"]) * shards / 0.9)) + 1
        same = (F.col("h") == g["h"]) & (F.col("text_crc32") == g["text_crc32"]) & (F.col("size") == g["size"])
        part = F.when(same, F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(part)
    rows = rows.withColumn("part", part)
    units = rows.groupBy(*key, "part").agg(*sums)
    steps = lambda x, k: F.floor(F.log2(x) * k).cast("int")
    cls = [steps(F.col("b"), 32).alias("cb"), steps(F.col("b") / F.greatest(F.col("w"), F.lit(1)), 8).alias("cw"), steps(F.col("r"), 8).alias("cr")]
    units = stored(units.select("*", *cls), "units")
    named = ["cb", "cw", "cr"]
    classes = units.groupBy(*named).agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("r").alias("r")).collect()
    classes.sort(key=lambda c: (c["cb"], c["cw"], c["cr"]))
    counts = place([(c["n"], int(c["b"]), int(c["w"]), int(c["r"])) for c in classes], shards)
    starts = [(c["cb"], c["cw"], c["cr"], [int(x) for x in t.cumsum()]) for c, t in zip(classes, counts)]
    plan = spark.createDataFrame(starts, "cb int, cw int, cr int, ends array<long>")
    order = ranked(units, named, [*key, "part"], "rank").join(F.broadcast(plan), named)
    homes = stored(order.select(*key, "part", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")), "homes")
    placed = stored(rows.join(homes, [*key, "part"]).select("doc_id", "size", "text_crc32", "shard"), "placed")
    numbered = ranked(placed, ["shard"], ["doc_id"], "slot", 2_000)
    out = numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
    out = stored(out, "shards")
    dropped(made, units, homes, placed)
    return out


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and its slot there."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
