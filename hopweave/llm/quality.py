"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of statistics (logs and logits of lengths, character-class
shares, repetition of words and lines). Per class, mean and covariance come from sums that Spark
aggregates over all training rows; the covariance is shrunk towards a scaled identity, its Cholesky
factor is inverted once, and a text's score is the calibrated difference of the two log densities.

Defined cases: a null text counts as an empty one; empty texts get a score like any other; with
fewer than two training rows of either class every score is 0.5 and every prediction 0. Rows with a
null doc_id or a null label are never learned from. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import bounded_batches, crc_fold, stored

FEATURES = (
    "log_words", "log_mean_word", "log_line", "upper", "digit", "common_punct", "other_punct", "non_ascii", "distinct_words",
    "top_word", "repeat_next", "distinct_lines", "short_words", "capital_starts", "symbol_ends", "stop_ends",
)


def _byte_classes() -> np.ndarray:
    """Per byte value: white space, upper case, digit, common punctuation, other ASCII punctuation, non-ASCII."""
    out = np.zeros((256, 6))
    for b in range(256):
        c = chr(b)
        out[b] = (
            c in " \t\n\r\x0b\x0c", "A" <= c <= "Z", "0" <= c <= "9", c in ".,;:'\"-?()",
            b < 128 and not c.isalnum() and c not in " \t\n\r\x0b\x0c.,;:'\"-?()", b >= 128,
        )
    return out


_CLASSES = _byte_classes()


def _tallied(raw: bytes) -> np.ndarray:
    """How many bytes there are of each class."""
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text: logs of means, then smoothed logits of shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    k = len(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts, sizes = Counter(words), [*map(len, words)]
    space, upper, digit, common, other, high = _tallied(raw)
    starts = _tallied(bytes([w[0] for w in words]))
    ends = _tallied(bytes([w[-1] for w in words]))
    chars = len(raw) - space
    parts = np.array([
        upper, digit, common, other, high, len(counts), max(counts.values(), default=0), sum(map(eq, words, islice(words, 1, None))),
        len(set(lines)), sizes.count(1) + sizes.count(2), starts[1], ends[4], ends[3],
    ])
    wholes = np.array([chars] * 5 + [k] * 3 + [len(lines)] + [k] * 4)
    shares = np.log((parts + 0.5) / (np.maximum(wholes - parts, 0) + 0.5 + 0.02 * wholes))
    return np.concatenate([np.log1p([k, chars / max(k, 1), len(raw) / max(len(lines), 1)]), shares])


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, class means, inverted Cholesky factors, log terms and the calibration line."""

    shift: np.ndarray
    scale: np.ndarray
    means: tuple
    factors: tuple
    terms: tuple
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | good) - log p(x | bad), from Mahalanobis distances."""
        z = np.clip((x - self.shift) / self.scale, -12, 12)
        logs = [t - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, t in zip(self.means, self.factors, self.terms)]
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squashed(self.difference(x)) + self.offset, -500, 500)))


def squashed(d: np.ndarray) -> np.ndarray:
    return np.clip(d, -60, 60)


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, train_fold=None, shrinkage: float = 0.05) -> Discriminant | None:
    """Learn from all labelled rows outside the held-out fold; None where a class has under two rows.

    Only sums per class (one row of moments each) and a histogram of 241 score bins reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    fold = train_fold if train_fold is not None else F.lit(True)

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t).tolist() for t in pdf["text"]]})

    rows = docs.where(fold).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = stored(rows.mapInPandas(measure, "doc_id long, x array<double>").join(known, "doc_id").select("quality", "x"), "train")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["quality"]: r for r in train.groupBy("quality").agg(F.count("*").alias("n"), *sums).collect()}
    if min((found[c]["n"] if c in found else 0) for c in (0, 1)) < 2:
        return None
    stats = {}
    for c, r in found.items():
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        stats[c] = (r["n"], mean, second)
    n = sum(s[0] for s in stats.values())
    shift = sum(s[0] * s[1] for s in stats.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(s[0] * s[2] for s in stats.values()) / n) - shift**2, 1e-6))
    means, factors, terms = [], [], []
    for c in (0, 1):
        k, mean, second = stats[c]
        cov = (second - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        means.append((mean - shift) / scale)
        factors.append(np.linalg.inv(low))
        terms.append(-np.log(np.diag(low)).sum() + np.log(k / n))
    model = Discriminant(shift, scale, tuple(means), tuple(factors), tuple(terms))
    shared = spark.sparkContext.broadcast(model)

    def binned(batches):
        for pdf in batches:
            delta = squashed(shared.value.difference(_rows(pdf["x"])))
            yield pd.DataFrame({"bin": np.round(delta * 2).astype("int64"), "quality": pdf["quality"]})

    hist = train.mapInPandas(binned, "bin long, quality int").groupBy("bin", "quality").count().collect()
    a, b = _line(np.array([r["bin"] / 2 for r in hist]), np.array([r["quality"] for r in hist]), np.array([r["count"] for r in hist]))
    return Discriminant(shift, scale, tuple(means), tuple(factors), tuple(terms), a, b)


def _line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method, with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(w * (y - p) * x).sum() - 1e-2 * (a - 1), (w * (y - p)).sum() - 1e-2 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def score(docs: DataFrame, model: Discriminant | None, threshold: float = 0.7) -> DataFrame:
    """Score every whole text: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for pdf in batches:
            s = _scores(pdf["text"], shared.value)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= threshold).astype("int32") if shared.value else 0})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(judge, "doc_id long, score double, predicted int")


def _scores(texts: pd.Series, model: Discriminant | None) -> np.ndarray:
    if model is None or not len(texts):
        return np.full(len(texts), 0.5)
    return model.scores(np.stack([statistics(t) for t in texts]))


def keep_good(docs: DataFrame, model: Discriminant | None, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; all rows without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches):
        for pdf in batches:
            yield pdf[_scores(pdf["text"], shared.value) >= threshold]

    return docs.mapInPandas(sift, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the fold with remainder 2 is never learned from."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold)
    out = score(docs, model)
    return out.select("doc_id", fold.alias("held_out"), "score", "predicted")
