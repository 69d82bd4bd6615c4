"""Periodic run detection: all maximal repetitions of words with a long enough exponent, by the runs theorem.

Every run has a Lyndon root that is the longest Lyndon word at its start under one of two opposite orders, so the
longest Lyndon words hold roots of all runs. Of a batch of texts the words become numbers, ranks of suffixes come
from prefix doubling (suffixes of different texts never compare equal), and the longest Lyndon word at i ends before the
next smaller value of the inverse suffix array, or before the next larger one under the opposite order (whose
end of text is the largest word, hence the exact reverse). Each root is extended to the right by the least LCP between both
suffixes, from a sparse table, and to the left by the same on the reversed text.

A run of at least L words and E periods makes two suffixes share ceil(L (E - 1) / E) words, so texts whose
largest LCP is less have none and go no further. Memory for a text of n words is some 8 n log2(n) bytes; texts are
worked at in batches of BATCH words, longer ones alone.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text. Repeated rows give a row
each, null ids too; very long texts are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import bounded_batches, table

#: Words of the texts worked at together.
BATCH = 150_000
#: The fewest words and periods of a run.
LEAST, PERIODS = 24, 3
FOUND = "array<struct<start: long, length: long, period: long>>"


class Suffixes:
    """Suffix array, ranks and LCP of texts laid end to end: ``codes`` of all words, ``ends`` of the text of each word."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        n = len(codes)
        self.n, self.ends = n, ends
        rank, active = self._regrouped(np.arange(n), ends * (int(codes.max(initial=0)) + 1) + codes, np.zeros(n, np.int64))
        levels, h = [rank.astype(np.int32)], 1
        while len(active):
            after = active + h
            inside = after < ends[active]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            rank, active = self._regrouped(active, rank[active] * (n + 1) + second, rank)
            levels.append(rank.astype(np.int32))
            h *= 2
        self.isa = rank
        self.sa = np.empty(n, np.int64)
        self.sa[rank] = np.arange(n)
        self.lcp = self._lcp(levels)

    @staticmethod
    def _regrouped(at: np.ndarray, key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split groups of equal rank by key (which sorts by rank first); ranks count the smaller suffixes. Also the positions still tied."""
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        old = rank[at]
        place = np.arange(len(at))
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        outer = np.ones(len(at), bool)
        outer[1:] = old[1:] != old[:-1]
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        base = np.maximum.accumulate(np.where(outer, place, 0))
        out = rank.copy()
        out[at] = old + first - base
        alone = fresh & np.append(fresh[1:], True)
        return out, at[~alone]

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """LCP of each suffix with the one before it in the array: from the ranks of all doublings, longest first."""
        lcp = np.zeros(self.n, np.int32)
        k = np.flatnonzero(levels[0][self.sa[1:]] == levels[0][self.sa[:-1]]) + 1
        i, j, got = self.sa[k - 1].copy(), self.sa[k].copy(), np.zeros(len(k), np.int32)
        for d in range(len(levels) - 1, -1, -1):
            ranks = np.append(levels[d], -1)
            same = ranks[i] == ranks[j]
            i, j, got = i + (same << d), j + (same << d), got + (same << d).astype(np.int32)
        lcp[k] = got
        return lcp

    def kept(self, texts: np.ndarray, moved: np.ndarray) -> "Suffixes":
        """Of some of the texts (mask by word) alone, words renumbered by ``moved``."""
        out = object.__new__(Suffixes)
        mask = texts[self.sa]
        out.sa, out.lcp = moved[self.sa[mask]], self.lcp[mask]
        out.n = len(out.sa)
        out.isa = np.empty(out.n, np.int64)
        out.isa[out.sa] = np.arange(out.n)
        out.ends = moved[self.ends[texts] - 1] + 1
        return out

    def sparse(self) -> None:
        """The table of least LCPs over 2^k neighbours."""
        self.table = [self.lcp]
        while (w := 1 << len(self.table)) <= self.n:
            last = self.table[-1]
            self.table.append(np.minimum(last[: self.n - w + 1], last[w // 2 :][: self.n - w + 1]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j (different, of one text) share."""
        a, b = self.isa[i], self.isa[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for d in np.unique(k):
            at = k == d
            t = self.table[d]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(d)) + 1])
        return out


def next_smaller(values: list, end: int) -> list:
    """The position of the next smaller value, ``end`` if there is none."""
    out, open_ = [end] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs(texts: list[list], least: int = LEAST, periods: int = PERIODS) -> list[np.ndarray]:
    """Of each text (a list of words): its runs as rows (start, length, period), by start, then period."""
    none = np.zeros((0, 3), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: dict = defaultdict(count().__next__)
    codes = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found = [none] * len(texts)
    if not len(codes):
        return found
    suffixes = Suffixes(codes, stops[owner])
    deep = np.zeros(len(texts), bool)
    deep[owner[suffixes.sa[suffixes.lcp >= -(-least * (periods - 1) // periods)]]] = True
    if not deep.any():
        return found
    mask = deep[owner]
    moved = np.cumsum(mask) - 1
    s = suffixes.kept(mask, moved)
    codes, owner = codes[mask], owner[mask]
    s.sparse()
    roots = []
    begin = 0
    while begin < s.n:  # one text after the other
        end = int(s.ends[begin])
        isa = s.isa[begin:end]
        for values in (isa, -isa):
            to = np.array(next_smaller(values.tolist(), end - begin), np.int64) + begin
            at = np.flatnonzero(to < end)
            roots.append(np.stack([at + begin, to[at]]))
        begin = end
    i, j = np.concatenate(roots, 1)
    right = s.common(i, j)
    able = right > (periods - 2) * (j - i)  # as the first root of a run starts in its first period
    i, j, right = i[able], j[able], right[able]
    if not len(i):
        return found
    left = np.zeros(len(i), np.int64)
    back = Suffixes(codes[::-1].copy(), s.n - np.searchsorted(owner, owner[::-1]))
    back.sparse()
    begins = np.searchsorted(owner, owner[i])
    more = i > begins
    left[more] = back.common(s.n - i[more], s.n - j[more])  # word i - 1 is word n - i of the reversed text
    start, period = i - left, j - i
    length = j + right - start
    long = length >= np.maximum(least, periods * period)
    rows = np.unique(np.stack([owner[i], start - begins, length, period], 1)[long], axis=0)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for k, part in zip(np.unique(rows[:, 0]), np.split(rows[:, 1:], np.flatnonzero(np.diff(rows[:, 0])) + 1)):
        found[int(k)] = part
    return found


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def find_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed text of every row; ``docs`` has doc_id and text."""

    def work(batches):
        for pdf in batches:
            ids, waiting, held = [], [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids.append(doc)
                waiting.append(text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else [])
                held += len(waiting[-1])
                if held >= BATCH:
                    yield given(ids, waiting)
                    ids, waiting, held = [], [], 0
            if ids:
                yield given(ids, waiting)

    def given(ids, waiting):
        found = runs(waiting, least, periods)
        names = ("start", "length", "period")
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64"), "runs": [[dict(zip(names, map(int, r))) for r in f] for f in found],
            "collapsed": [collapsed(w, f).decode("utf-8", "surrogatepass") for w, f in zip(waiting, found)],
        })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(work, f"doc_id long, runs {FOUND}, collapsed string")


def strongest(found: Column) -> Column:
    """The run of the greatest exact length / period, ties by start, then period; null without runs."""
    ahead = lambda a, b: (
        (b["length"] * a["period"] > a["length"] * b["period"])
        | ((b["length"] * a["period"] == a["length"] * b["period"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))
    )
    return F.when(F.size(found) > 0, F.aggregate(found, F.element_at(found, 1), lambda a, b: F.when(ahead(a, b), b).otherwise(a)))


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the tail of one text in ten made periodic by its id, as the query's contract asks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"), g.alias("g"))
    n = F.size("w").cast("long")
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    words = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", place(i).cast("int")))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", words)).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    bounded_batches(spark)
    found = find_runs(rewritten(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
