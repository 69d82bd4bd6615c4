"""Segmentation of unspaced text: the cheapest path through the lattice of dictionary words.

A word costs -ln(its share of all counts), a character that begins no word UNKNOWN counts' worth. Words are looked up by
64-bit hashes, one table for each length, at all places of many texts at once; the best path is found by dynamic
programming from the end; of equally cheap ones the longest first word is taken. Words over GATE characters are only looked
for where such a word begins with the same GATE. A dictionary is a table in the shared folder that workers read, some
25 bytes a word; a larger one than PIECE words is read in pieces, one after the other, for each batch of texts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.storage import bounded_batches, checkpointed, fresh

#: Chinese characters are segmented; runs of ASCII letters and digits are words as they are.
CJK, ASCII = "[一-龥]+", "[a-zA-Z0-9]+"
#: What a character outside the dictionary counts as; most words of a dictionary, where it is limited.
UNKNOWN, MOST_WORDS = 0.5, 2_000_000
#: Characters that a longer word is first looked for by; characters segmented at once; words a worker holds.
GATE, BLOCK, PIECE = 6, 300_000, 32_000_000
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """A sequence of characters whose substrings have hashes that don't depend on where they are."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = lambda base: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(codes), base, np.uint64))])
        self.n, self.back = len(codes), powers(pow(_BASE, -1, 2**64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * powers(_BASE)[:-1], dtype=np.uint64)])

    def keys(self, at: np.ndarray, size) -> np.ndarray:
        """Of the substrings of ``size`` characters at these places."""
        return _mixed((self.sums[at + size] - self.sums[at]) * self.back[at])

    def all_keys(self, size: int) -> np.ndarray:
        """Of the substrings of ``size`` characters at every place."""
        m = max(self.n - size + 1, 0)
        return _mixed((self.sums[size : size + m] - self.sums[:m]) * self.back[:m])


class Flags:
    """Which keys may be in a set: one bit for each value of their first bits, some sixteen or more a key."""

    def __init__(self, keys: np.ndarray):
        k = min(max(len(keys) * 16, 1024).bit_length(), 32)
        self.shift = np.uint64(64 - k)
        flags = np.zeros(2**k, bool)
        flags[keys >> self.shift] = True
        self.bits = np.packbits(flags, bitorder="little")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


class Table:
    """Costs by key, for the words of one length: sorted keys, with where each value of their first bits begins."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.costs, self.flags = keys[order], costs[order], Flags(keys)
        k = len(keys).bit_length()
        self.shift = np.uint64(64 - k)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.keys >> self.shift, minlength=2**k))]).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are here, and their costs."""
        b = keys >> self.shift
        at, end = self.starts[b], self.starts[b + np.uint64(1)]
        left, which, costs = np.flatnonzero(at < end), [], []
        while len(left):
            same = self.keys[at[left]] == keys[left]
            which.append(left[same])
            costs.append(self.costs[at[left[same]]])
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return (np.concatenate(which), np.concatenate(costs)) if which else (np.zeros(0, np.int64), np.zeros(0))


class Piece:
    """Words of a dictionary, by length."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, gates: np.ndarray, costs: np.ndarray):
        self.tables = {int(s): Table(keys[sizes == s], costs[sizes == s]) for s in np.unique(sizes)}
        self.gate = Flags(gates[sizes > GATE])

    def matches(self, run: Hashed, ends: np.ndarray):
        """(places, size, costs) of all words; ``ends``: where the text at each place ends."""
        begun = self.gate(run.all_keys(GATE)) if max(self.tables, default=0) > GATE else None
        for size, table in self.tables.items():
            if size > GATE:
                at = begun = begun[begun + size <= ends[begun]]  # sizes grow
                keys = run.keys(at, size)
                maybe = table.flags(keys)
                at, keys = at[maybe], keys[maybe]
            else:
                keys = run.all_keys(size)
                at = table.flags(keys)
                at = at[at + size <= ends[at]]
                keys = keys[at]
            which, costs = table.find(keys)
            yield at[which], size, costs


def keyed(words: list[str], counts: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, keys, keys of the first GATE characters, and costs of words."""
    text = Hashed("".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(sizes) - sizes
    return sizes, text.keys(at, sizes), text.keys(at, np.minimum(sizes, GATE)), -np.log(counts / (total + UNKNOWN))


def _paths(offsets: list[int], sizes: list[int], costs: list[float], first: int, n: int, unknown: float) -> list[int]:
    """The length of the best first word at each of ``n`` places from ``first`` on."""
    best, step = [0.0] * (n + 1), [1] * n
    end = offsets[first + n]
    for i in range(n - 1, -1, -1):
        cost, size = unknown + best[i + 1], 1
        begin = offsets[first + i]
        for k in range(begin, end):
            s = sizes[k]
            c = costs[k] + best[i + s]
            if c < cost or c == cost and s >= size:
                cost, size = c, s
        best[i], step[i], end = cost, size, begin
    return step


class Dictionary:
    """Words and their counts, or ``pieces`` (calls that give one) with the total of their counts."""

    def __init__(self, counts: dict[str, float] | None = None, pieces: tuple = (), total: float = 0.0):
        if counts is not None:
            known = {w: n for w, n in counts.items() if w and n > 0}
            total = sum(counts.values()) or 1
            made = Piece(*keyed(list(known), np.array(list(known.values()), float), total))
            pieces = (lambda: made,)
        self.pieces, self.unknown = pieces, -math.log(UNKNOWN / ((total or 1) + UNKNOWN))

    def cut(self, text: str) -> list[str]:
        """The words of a run of characters."""
        return self.cut_all([text])[0]

    def cut_all(self, runs: list[str]) -> list[list[str]]:
        """The words of runs of characters, some BLOCK characters at once."""
        out, begin, size = [], 0, 0
        for i, r in enumerate(runs):
            size += len(r)
            if size >= BLOCK or i + 1 == len(runs):
                out += self._block(runs[begin : i + 1])
                begin, size = i + 1, 0
        return out

    def _block(self, runs: list[str]) -> list[list[str]]:
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(lengths)
        hashed = Hashed("".join(runs))
        found = [m for p in self.pieces for m in p().matches(hashed, np.repeat(ends, lengths))]
        n = np.zeros(hashed.n + 1, np.int64)
        for at, _, _ in found:
            n[at + 1] += 1  # a place has one word of a length
        offsets = np.cumsum(n)
        to, sizes, costs = offsets.copy(), np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1])
        for at, size, cost in found:
            sizes[to[at]], costs[to[at]] = size, cost
            to[at] += 1
        offsets, sizes, costs, out = offsets.tolist(), sizes.tolist(), costs.tolist(), []
        for run, first in zip(runs, (ends - lengths).tolist()):
            step, words, i = _paths(offsets, sizes, costs, first, len(run), self.unknown), [], 0
            while i < len(run):
                words.append(run[i : i + step[i]])
                i += step[i]
            out.append(words)
        return out


#: The piece that the worker has read last.
_held: dict[str, Piece] = {}


def _read(folder: str) -> Piece:
    if folder not in _held:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _held.clear()
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        t = pq.read_table(path, filesystem=store, partitioning=None)
        whole = lambda c: t[c].to_numpy()
        _held[folder] = Piece(whole("size"), whole("key").view(np.uint64), whole("gate").view(np.uint64), whole("cost"))
    return _held[folder]


def _shared(words: DataFrame, n: int, total: float) -> tuple[str, ...]:
    """The folders of a dictionary's pieces (word, n)."""
    pieces = -(-n // PIECE)

    def hashed(batches):
        for pdf in batches:
            sizes, keys, gates, costs = keyed(pdf["word"].tolist(), pdf["n"].to_numpy(float), total)
            yield pd.DataFrame({"size": sizes, "key": keys.view(np.int64), "gate": gates.view(np.int64), "cost": costs, "piece": (keys % np.uint64(max(pieces, 1))).astype(np.int32)})

    folder = fresh(words.sparkSession, "dictionary")
    words.mapInPandas(hashed, "size long, key long, gate long, cost double, piece int").write.partitionBy("piece").parquet(folder)
    return tuple(f"{folder}/piece={i}" for i in range(pieces))


def segmented(docs: DataFrame, dictionary: DataFrame, column: str = "text", runs: str = CJK, others: str = ASCII, out: str = "words", limited: bool = True) -> DataFrame:
    """Add an array column of words: those of ``runs`` by the dictionary (word, n), ``others`` as they are, all else left out; null for null.

    A ``limited`` dictionary of more than MOST_WORDS words is refused.
    """
    bounded_batches(docs.sparkSession)
    known = checkpointed(dictionary.where("word is not null and word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("double").alias("n")), "words")
    size = known.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total")).first()
    if limited and size["words"] > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    total = size["total"]
    folders = _shared(known, size["words"], total)
    pattern = re.compile(f"(?P<run>{runs})|{others}" if others else f"(?P<run>{runs})")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        found = [None if t is None else [(m.group(), m.group("run") is not None) for m in pattern.finditer(t)] for t in texts]
        cut = iter(Dictionary(pieces=tuple(lambda f=f: _read(f) for f in folders), total=total).cut_all([w for ms in found for w, run in ms or () if run]))
        return pd.Series([None if ms is None else [x for w, run in ms for x in (next(cut) if run else (w,))] for ms in found], dtype=object)

    return docs.withColumn(out, words(F.col(column)))
