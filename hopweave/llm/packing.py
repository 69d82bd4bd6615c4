"""Packing: cutting-stock column generation, with a cuttable reserve that fills what is left over.

Texts become token ids once, by the given tokenizer. A document is cut into whole sequences and a rest;
the rests' lengths form a histogram of at most 256 classes of 16 tokens or, where pieces are so short that rounding
them up would leave more than the reserve can fill, finer ones for these (384 classes at most). Over it a linear program chooses patterns
(how many rests of each class share a sequence): starting from one pattern per class, a knapsack
dynamic program prices the best new pattern from the duals until none improves. The solution is
rounded down, the few rests left over are packed first-fit, and each pattern's slots go to the rests by
their rank within a class, so the driver only ever sees the histogram.

One document in ``reserve`` (by a hash of its id) is kept out as stock that may be cut anywhere. Laid end
to end in slices of STOCK ids, the stock is cut at the gaps that rounding leaves in the sequences; what
remains of it makes whole sequences and at last ones whose length is a power of two. While the stock lasts
there is no padding at all.

Column generation stops when no pattern prices out, when the bound it gives shows that less than one
sequence is left to gain, or when the total hasn't changed for STALLED steps (a degenerate basis); whatever
it stops at, rounding covers every rest, so only padding could differ.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: a special string in a text is its
special id. A text is encoded whole by one worker, which holds its ids (four bytes each) at once.

Defined cases: a null text is an empty one and gives only the end id; a null doc_id is packed like any
other; rows that repeat are packed each; a very long text is many pieces, in a plan of its own only by its
last one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.llm._common import cumulated, dropped, ranked, released, stored

CAPACITY = 4096
CLASSES = 256
RESERVE = 32
#: Units up to which lengths have classes of one unit, and the share of the stock that rounding may be expected to take.
FINE, FILLED = 128, 0.7
#: Ids of a slice of the stock (64 KB), and steps without a gain after which column generation ends.
STOCK = 16_384
STALLED = 500
#: Words remembered by a worker (some 200 bytes each), and fewer where a worker has to do with other stages too; four times as many
#: characters of text are encoded at once.
REMEMBERED, FEWER = 400_000, 120_000
_ODD_SPACES = re.compile("[\x1c-\x1f]")
#: Beyond these, lower case and composition depend on more than the single character.
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")


class WordEncoder:
    """Ids of whole texts as little-endian bytes, by words: in this vocabulary no token spans white space.

    New words of a slice that are only letters go to the tokenizer as one text, as each ends in exactly one
    token that closes a word; other new words go one by one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)", re.I).search
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words made of letters only."""
        out: list[bytes] = []
        for s in range(0, len(words), 20_000):
            part = words[s : s + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                out += map(self.whole, part)
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def learned(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new words; a mark at the end of a word of letters is a token of its own."""
        ends = {w: (w[:-1], w[-1]) for w in new if w[-1] in ".,;:!?" and w[:-1].isalpha()}
        cores = sorted({c for c, _ in ends.values() if c not in self.known} | {w for w in new if w.isalpha()})
        got = dict(zip(cores, self._letters(cores)))
        marks = {m: self.whole(m) for m in {m for _, m in ends.values()}}
        for w in new:
            if w in ends:
                core, mark = ends[w]
                got[w] = (got.get(core) or self.known[core]) + marks[mark]
            elif w not in got:
                got[w] = self.whole(w)
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, in slices of bounded size."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= 4 * self.remembered:
                out += self._slice(held)
                held, size = [], 0
        return out + self._slice(held)

    def _slice(self, texts: list[str]) -> list[bytes]:
        split = [None if _ODD_SPACES.search(t) or self.special(t) else (t if _BEYOND.search(t) else t.lower()).split() for t in texts]
        new = set().union(*(w for w in split if w)) - self.known.keys()
        fresh = self.learned(new)
        self.known.update(fresh)
        get = self.known.__getitem__
        out = [self.whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split)]
        if len(self.known) > self.remembered:  # what came first is the most frequent; the newest go again
            for w in fresh:
                self.known.pop(w, None)
        return out


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = WordEncoder(path, remembered)
    return _encoders[path, remembered]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, reserve: int = RESERVE, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the fixed pieces; slices of stock documents keep their ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(tokenizer, remembered)
        for pdf in batches:
            rows = []
            for doc_id, ids, stock in zip(pdf["doc_id"], enc.ids([t or "" for t in pdf["text"]]), pdf["stock"]):
                ids += end
                n = len(ids) // 4
                step = STOCK if stock else capacity
                for s in range(0, n, step):
                    part = ids[4 * s : 4 * (s + step)]
                    rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), n, part if stock else None))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        released()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.pmod(F.xxhash64("doc_id"), F.lit(reserve)) == 0).alias("stock"))
    return rows.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _priced(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of at most ``room`` units, and its value."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        fit = useful[sizes[useful] <= w]
        if len(fit):
            gains = best[w - sizes[fit]] + values[fit]
            k = int(gains.argmax())
            if gains[k] > best[w] + 1e-12:
                best[w], took[w] = gains[k], fit[k]
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
            continue
        pattern[took[w]] += 1
        w -= sizes[took[w]]
    return float(best[room]), pattern


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used: they cover the demand exactly. sizes in units, room in the same."""
    if not len(sizes):
        return []
    basis = np.diag(room // sizes).astype(float)
    inverse, amounts = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    total, stalled = float(amounts.sum()), 0
    while stalled < STALLED:
        duals = inverse.sum(0)
        value, column = _priced(duals, sizes, room)
        if value <= 1 + 1e-7 or total - total / value < 0.5:
            break
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, amounts / direction, np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        amounts = amounts - ratios[out] * direction
        amounts[out] = ratios[out]
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        stalled = stalled + 1 if amounts.sum() > total - 1e-9 * total else 0
        total = min(total, float(amounts.sum()))
    times = np.floor(np.maximum(amounts, 0) + 1e-9).astype(np.int64)
    found = [(basis[:, k].astype(np.int64), int(t)) for k, t in enumerate(times) if t > 0]
    left = demand.astype(np.int64).copy()
    kept = []
    for column, t in found:
        t = min([t, *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if t > 0:
            left -= column * t
            kept.append((column, t))
    order = np.argsort(-sizes, kind="stable")
    while left.any():  # first-fit decreasing over what rounding left, one sequence (or as many alike) at a time
        column, free = np.zeros_like(left), room
        for i in order:
            k = min(int(left[i]), free // int(sizes[i]))
            column[i], free = k, free - k * int(sizes[i])
        t = min(int(left[i] // column[i]) for i in np.flatnonzero(column))
        left -= column * t
        kept.append((column, t))
    return kept


def units(lengths: dict[int, int], capacity: int, reserve: int) -> int:
    """Tokens of a class: as many as leave gaps that the stock is likely to fill, fewer the shorter the pieces are."""
    tokens = sum(n * length for length, n in lengths.items())
    unit = capacity // CLASSES
    while unit > 1 and sum(n * (rounded(length, unit, capacity) * unit - length) for length, n in lengths.items()) > FILLED * tokens / reserve:
        unit //= 2
    return unit


def rounded(length: int, unit: int, capacity: int) -> int:
    """The class of a length, in units; pieces of more than FINE units have the classes of a coarse grid."""
    coarse = capacity // CLASSES
    return -(-length // unit) if length <= FINE * unit else -(-length // coarse) * (coarse // unit)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, reserve: int = RESERVE, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    made = stored(pieces(docs, tokenizer, end_id, capacity, reserve, remembered), "pieces")
    rests = made.where("ids is null").drop("ids")
    unit = units({r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}, capacity, reserve)  # at most ``capacity`` rows
    coarse = capacity // CLASSES
    fine = F.ceil(F.col("length") / unit)
    rests = rests.withColumn("cls", F.when(F.col("length") <= FINE * unit, fine).otherwise(F.ceil(F.col("length") / coarse) * (coarse // unit)).cast("int"))
    hist = sorted((r["cls"], r["count"]) for r in rests.groupBy("cls").count().collect())
    sizes, demand = np.array([c for c, _ in hist], np.int64), np.array([n for _, n in hist], np.int64)
    plan, sequences, done = [], 0, np.zeros(len(sizes), np.int64)
    for column, times in patterns(sizes, demand, capacity // unit):
        for i in np.flatnonzero(column):
            plan.append((int(sizes[i]), int(done[i]), int(column[i]), sequences))
            done[i] += column[i] * times
        sequences += times
    by_class: dict[int, tuple] = {}
    for c in set(x[0] for x in plan):
        mine = sorted(x[1:] for x in plan if x[0] == c)
        by_class[c] = tuple(np.array(v, np.int64) for v in zip(*mine))

    def assign(batches):
        for pdf in batches:
            seq = np.zeros(len(pdf), np.int64)
            for c, at in pdf.groupby("cls").indices.items():
                starts, each, base = by_class[int(c)]
                rank = pdf["rank"].to_numpy()[at]
                k = np.searchsorted(starts, rank, "right") - 1
                seq[at] = base[k] + (rank - starts[k]) // each[k]
            pdf["sequence_id"] = seq
            yield pdf.drop(columns=["cls", "rank"])

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = stored(ranked(rests, ["cls"], ["doc_id", "start"], "rank").select(*rests.columns, "rank").mapInPandas(assign, columns), "placed")
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)))

    stock = stored(made.where("ids is not null").select("doc_id", F.col("start").alias("first"), "length", "doc_tokens", "ids"), "stock")
    gaps = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).select("sequence_id", "used", (F.lit(capacity) - F.col("used")).alias("gap")).where("gap > 0")
    totals = gaps.agg(F.sum("gap")).first()[0] or 0, stock.agg(F.sum("length")).first()[0] or 0
    rest = max(0, totals[1] - totals[0])
    spark = docs.sparkSession
    whole = spark.range(rest // capacity).select((F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(capacity).cast("long").alias("gap"))
    powers = [1 << b for b in reversed(range(capacity.bit_length() - 1)) if rest % capacity >> b & 1]
    tail = spark.createDataFrame([(sequences + rest // capacity + k, 0, p) for k, p in enumerate(powers)], "sequence_id long, used long, gap long")
    gaps = stored(gaps.unionByName(whole).unionByName(tail), "gaps")
    bucket = 4 * max(capacity, STOCK)  # so a slice meets at most two
    holes = cumulated(gaps, "gap", ["sequence_id"], "g0").withColumn("g1", F.col("g0") + F.col("gap"))
    line = cumulated(stock, "length", ["doc_id", "first"], "d0", per_block=1_000).withColumn("d1", F.col("d0") + F.col("length")).drop("length")
    spread = lambda df, a, b: df.withColumn("b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket))))
    at = F.greatest("g0", "d0")
    cut = (
        spread(holes, "g0", "g1").join(spread(line, "d0", "d1"), "b")
        .where((F.col("g0") < F.col("d1")) & (F.col("d0") < F.col("g1")) & (F.floor(at / bucket) == F.col("b")))
        .select("doc_id", "doc_tokens", "ids", "sequence_id", "first", (at - F.col("d0")).alias("from"), (F.least("g1", "d1") - at).alias("length"), (F.col("used") + at - F.col("g0")).alias("offset"))
        .withColumn("ids_crc32", F.crc32(F.expr("substring(ids, cast(4 * from + 1 as int), cast(4 * length as int))")))
        .withColumn("start", F.col("first") + F.col("from"))
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = stored(fixed.select(*out).unionByName(cut.select(*out)), "packed")
    dropped(made, placed, stock, gaps)
    return packed


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
