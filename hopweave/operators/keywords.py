"""Keywords of texts: tf-idf with document frequencies of the whole corpus, TextRank on each text's own word graph.

Both take (doc_id, words: array<string>). Words are counted where their document lies, so no token is shuffled, only
one row for each word of a document, and these join their frequencies: words of very many documents (few words, by their
number) by broadcast, all others by shuffle, so no word is one task's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.text import counted as counts
from hopweave.storage import bounded_batches, checkpointed

#: A word in more than one of so many (document, word) rows is frequent; there are at most so many of them.
FREQUENT = 1_000


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, word, n, total of every word of a document."""
    known = docs.where("doc_id is not null and words is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "words")
    return known.select("doc_id", F.size("words").cast("long").alias("total"), F.inline(counts(F.col("words")))).select("doc_id", "word", "n", "total")


def tf_idf(docs: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, rank, word, weight: the k words of the greatest share of their document times ln((1 + N) / (1 + df)) + 1; ties go to the word."""
    n = docs.where("doc_id is not null").count()
    words = checkpointed(counted(docs), "words")
    df = checkpointed(words.groupBy("word").agg(F.count("*").alias("df")), "df")
    rows = df.agg(F.sum("df")).first()[0] or 0
    often = df.where(F.col("df") * FREQUENT > rows)
    common = words.join(F.broadcast(often), "word")
    rare = words.join(F.broadcast(often.select("word")), "word", "left_anti").join(df.where(F.col("df") * FREQUENT <= rows), "word")
    weight = F.round(F.col("n") / F.col("total") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1), 6)
    weighed = common.unionByName(rare).select("doc_id", "word", weight.alias("weight"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "word")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", F.col("rank").cast("long").alias("rank"), "word", "weight")


def ranked_words(words: list[str], span: int = 5, rounds: int = 10, damping: float = 0.85) -> tuple[list[str], np.ndarray]:
    """Distinct words and their ranks after so many rounds of power iteration on the graph of words less than ``span`` apart."""
    codes, names = pd.factorize(np.array(words, object))
    n = len(names)
    a = np.concatenate([codes[:-d] for d in range(1, span)] or [codes[:0]])
    b = np.concatenate([codes[d:] for d in range(1, span)] or [codes[:0]])
    a, b = a[a != b], b[a != b]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pair, weight = np.unique(a * n + b, return_counts=True) if n else (np.zeros(0, np.int64), np.zeros(0))
    a, b = np.divmod(pair, max(n, 1))
    out = np.bincount(a, weight, n)
    rank = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        rank = 1 - damping + damping * np.bincount(b, weight * rank[a] / out[a], n)
    return list(names), rank


def text_rank(docs: DataFrame, k: int = 10, span: int = 5, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """doc_id, rank, word, weight (5 decimals): the k words of the highest TextRank of each document; ties go to the word. No shuffle."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        for pdf in batches:
            rows = []
            for d, ws in zip(pdf["doc_id"], pdf["words"]):
                if ws is None or not len(ws):
                    continue
                names, rank = ranked_words(list(ws), span, rounds, damping)
                best = sorted(zip(-np.round(rank, 5), names))[:k]
                rows += [(d, i + 1, w, -r) for i, (r, w) in enumerate(best)]
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "word", "weight"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "words").mapInPandas(work, "doc_id long, rank long, word string, weight double")
