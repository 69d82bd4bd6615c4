"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every non-letter below U+0080 becomes a space, and all n-grams of one to three
characters are hashed into a fixed number of buckets. Counts per (language, bucket) are summed by
Spark over every training text; the log-probability matrix (languages x buckets) is broadcast, its
size being fixed by the two parameters, and batches are scored with sparse gathers in numpy.

Defined cases: null texts and texts without a letter get ``und`` with score 0, as does everything when
nothing could be learned. Rows with a null lang or doc_id are never learned from, rows that repeat count
each. Ties go to the language that sorts first. A very long text is scored whole; an empty table gives no
rows; extra columns are ignored.

A filter (keep_known) also rejects texts in no learned language, whose posterior may still be one: those whose
mean log-probability lies UNLIKE deviations under that of their best language's own texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import bounded_batches, crc_fold

BUCKETS = 1 << 15
#: The matrix has at most this many languages; beyond it fit() raises.
MAX_LANGUAGES = 512
#: Deviations below its language's mean from which a text is in none of them, and what short texts (by the root of their n-grams) may add.
UNLIKE, SHORT = 1.4, 6.0
#: What a character below U+0080 counts as: itself for a letter, else a space.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram (n = 1, 2, 3) of a text; buckets is a power of two."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, _PLAIN[c & np.uint32(127)], c)
    one = (c + np.uint32(1)) * _MULT[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MULT[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MULT[2] + c[2:]
    h = np.concatenate([one, two * _MULT[0], three * _MULT[0]])
    return ((h ^ (h >> np.uint32(16))) & np.uint32(buckets - 1)).astype(np.int32)


@dataclass(frozen=True)
class Bayes:
    languages: tuple
    logs: np.ndarray
    #: Per language, mean and standard deviation of its n-grams' log-probability over its own training texts.
    means: np.ndarray
    spreads: np.ndarray

    def likeness(self, text: str) -> tuple[float, int]:
        """How many deviations a text's mean log-probability in its best language lies above that language's own, and its number of n-grams."""
        at, n = np.unique(grams(text, self.logs.shape[0]), return_counts=True)
        s = n @ self.logs[at]
        k = int(s.argmax())
        return float((s[k] / n.sum() - self.means[k]) / self.spreads[k]), int(n.sum())

    def known(self, text) -> bool:
        """Whether a text is in one of the languages: a posterior saturates, a text's likeness to its best language doesn't."""
        if not self.languages or not isinstance(text, str) or not has_letter(text):
            return False
        like, n = self.likeness(text)
        return like >= -UNLIKE - SHORT / np.sqrt(n)

    def predict(self, texts) -> tuple[list, np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for k, t in enumerate(texts):
            if not self.languages or not isinstance(t, str) or not has_letter(t):
                names.append("und")
                continue
            at, n = np.unique(grams(t, self.logs.shape[0]), return_counts=True)
            s = n @ self.logs[at]
            best = int(s.argmax())
            p = np.exp(s - s[best])
            names.append(self.languages[best])
            scores[k] = 1 / p.sum()
        return names, scores


def fit(docs: DataFrame, train_fold=None, buckets: int = BUCKETS, smoothing: float = 0.5) -> Bayes:
    """Count n-grams per language over the whole text of every training row."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    rows = rows.where(train_fold) if train_fold is not None else rows

    def count(batches):
        total: dict[str, np.ndarray] = {}
        waiting: dict[str, list] = {}

        def add(lang: str) -> None:
            total[lang] += np.bincount(np.concatenate(waiting.pop(lang)), minlength=buckets)

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                total.setdefault(lang, np.zeros(buckets, np.int64))
                if has_letter(text):
                    held = waiting.setdefault(lang, [])
                    held.append(grams(text, buckets))
                    if len(held) == 200:
                        add(lang)
        for lang in [*waiting]:
            add(lang)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            for s in range(0, len(at), 8192):
                part = at[s : s + 8192]
                yield pd.DataFrame({"lang": lang, "bucket": part, "n": c[part]})

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    logs = np.full((buckets, max(len(counted), 1)), smoothing)
    for k, r in enumerate(counted):
        logs[[x["bucket"] for x in r["c"]], k] += [x["n"] for x in r["c"]]
    shares = logs / logs.sum(0)
    logs = np.log(shares)
    means = (shares * logs).sum(0)
    return Bayes(tuple(r["lang"] for r in counted), logs, means, np.sqrt((shares * (logs - means) ** 2).sum(0)) + 1e-9)


def identify(docs: DataFrame, model: Bayes) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for pdf in batches:
            names, scores = shared.value.predict(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(judge, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Bayes, threshold: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least the given score and that are like it, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches):
        for pdf in batches:
            names, scores = shared.value.predict(pdf["text"])
            sure = (np.array(names, object) != "und") & (scores >= threshold)
            yield pdf[[bool(s and shared.value.known(t)) for s, t in zip(sure, pdf["text"])]]

    return docs.mapInPandas(sift, docs.schema) if model.languages else docs


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the fold with remainder 1 is never learned from."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False))
    return identify(docs, fit(docs, ~fold)).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
