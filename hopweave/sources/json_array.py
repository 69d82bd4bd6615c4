"""Large JSON files as tables: the elements of a file's array, or of the arrays in its object, read by many tasks.

Spark's text source splits a file into byte ranges, here with the closing brace as the end of a record, so it works in any
store that Spark reads. What a range means depends on what came before it. A first pass describes each range under
every state it could begin in (outside a string, inside one, after a backslash): the state it ends in and the change of depth. Composed in
order (one small row a range) they say the state each range begins in. A second pass then cuts each range at the
commas and brackets of the element depth. An element belongs to the range it begins in; where it goes on beyond it, its pieces
are joined by its number. Memory is that of an Arrow batch of records.

Elements are those of the file's array (field ''), or of each array that is a value of the file's object (field: its
key). A file that isn't one JSON array or object has none. Brackets that don't match give elements that don't parse,
never an error. Arrays without any brace (of plain strings or numbers) are one record unless another ``separator`` is named.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.storage import checkpointed

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)
#: Bytes before an opening bracket in which its key is looked for.
_KEY_BYTES = 4_096
#: States a range can begin in: outside strings, inside one, inside one after a backslash.
OUT, STRING, ESCAPED = 0, 1, 2
#: Bytes looked at together.
CHUNK = 4_000_000
_BLANK = b"\xef\xbb\xbf \t\r\n"
_CODES = np.zeros(256, np.int8)
for _c, _d in ((b"[", 1), (b"{", 1), (b"]", -1), (b"}", -1)):
    _CODES[_c[0]] = _d


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, their change of depth (0 for a comma), and the state after the last byte."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    place = np.arange(n)
    slash = b == 92
    # A quote counts unless an odd run of backslashes ends right before it (one that the range began with included).
    plain = np.maximum.accumulate(np.where(slash, -1, place)) if n else place
    before = np.concatenate([[-1], plain[:-1]]) if n else plain
    runs = place - 1 - before + ((before < 0) & (state == ESCAPED))
    quote = (b == 34) & (runs % 2 == 0)
    inside = (np.cumsum(quote) + (state != OUT)) % 2 == 1
    after = OUT
    if n:
        last = int(n - 1 - plain[-1] + (plain[-1] < 0 and state == ESCAPED))
        after = (ESCAPED if last % 2 else STRING) if inside[-1] else OUT
    else:
        after = state
    known = (_CODES[b] != 0) | (b == 44)
    at = np.flatnonzero(known & ~inside)
    return at, _CODES[b[at]].astype(np.int64), after


def _records(batches, end: bytes):
    """(path, block, bytes) of runs of records of one byte range, of CHUNK bytes or little more."""
    for pdf in batches:
        path, block, held, size = None, None, [], 0
        for p, b, v in zip(pdf["path"], pdf["block"], pdf["value"]):
            if held and (size > CHUNK or (p, b) != (path, block)):
                yield path, block, end.join(held) + end
                held, size = [], 0
            path, block = p, int(b)
            held.append(v.encode())
            size += len(held[-1])
        if held:
            yield path, block, end.join(held) + end


def _described(batches, end: bytes):
    """Per range: the state after it and its change of depth for each state before it, and its first byte that is no blank."""
    found: dict = {}
    for path, block, data in _records(batches, end):
        states, depths, first = found.get((path, block)) or ([OUT, STRING, ESCAPED], [0, 0, 0], b"")
        first = first or data.lstrip(_BLANK)[:1]
        for k in range(3):
            _, change, states[k] = structure(data, states[k])
            depths[k] += int(change.sum())
        found[path, block] = states, depths, first
    if found:
        yield pd.DataFrame([(p, b, s, d, f.decode("latin-1")) for (p, b), (s, d, f) in found.items()], columns=["path", "block", "states", "depths", "first"])


def _beginnings(ranges: list) -> dict:
    """(path, block) -> state, depth and element depth at its beginning, from the descriptions in order."""
    out, path = {}, None
    for r in sorted(ranges, key=lambda r: (r["path"], r["block"])):
        if r["path"] != path:
            path, state, depth, level = r["path"], OUT, 0, {"[": 1, "{": 2}.get(r["first"], 0)
        out[path, r["block"]] = state, depth, level
        state, depth = r["states"][state], depth + r["depths"][state]
    return out


#: border: how many borders of elements of the range lie before; opened: the border of the range that opened the array they are in, and its key
#: (null: something that is no array of elements); edge: whether the element may go on in another piece.
_PIECES = "path string, block long, part int, border long, opened long, key string, edge boolean, text string"


class _Cutter:
    """Cuts one byte range, given in order, at the borders of its elements."""

    def __init__(self, path: str, block: int, begin: tuple[int, int, int]):
        self.where = path, block
        self.state, self.depth, self.level = begin
        self.border, self.part, self.opened, self.key, self.tail, self.recent = 0, 0, None, None, b"", b""

    def _row(self, data: bytes, edge: bool) -> tuple:
        return *self.where, self.part, self.border, self.opened, self.key, edge, data.decode("utf-8", "replace")

    def feed(self, data: bytes) -> list[tuple]:
        at, change, self.state = structure(data, self.state)
        depths = self.depth + np.cumsum(change)
        self.depth = int(depths[-1]) if len(depths) else self.depth
        level, rows, since = self.level, [], 0
        # At the element depth: a comma, a bracket that reaches it, or one that leaves it.
        mine = ((change >= 0) & (depths == level)) | ((change == -1) & (depths == level - 1))
        for k in np.flatnonzero(mine) if level else ():
            i = int(at[k])
            rows.append(self._row(self.tail + data[since:i], self.border == 0 or self.part > 0))
            self.tail, since, self.part, self.border = b"", i + 1, 0, self.border + 1
            if change[k]:
                self.opened, self.key = self.border, None
                if change[k] == 1 and data[i : i + 1] == b"[":
                    key = _KEY.search((self.recent if i < _KEY_BYTES else b"") + data[max(0, i - _KEY_BYTES) : i]) if level == 2 else None
                    self.key = key.group(1).decode("utf-8", "replace") if key else ""
        self.tail += data[since:]
        self.recent = (self.recent + data)[-_KEY_BYTES:] if len(data) < _KEY_BYTES else data[-_KEY_BYTES:]
        if len(self.tail) > CHUNK:  # a long element doesn't wait for its end
            cut = len(self.tail) - 8
            while cut > 0 and self.tail[cut] & 0xC0 == 0x80:  # not within a character
                cut -= 1
            rows.append(self._row(self.tail[:cut], True))
            self.tail, self.part = self.tail[cut:], self.part + 1
        return rows

    def end(self) -> list[tuple]:
        return [self._row(self.tail, True)]


def _cut(batches, end: bytes, begins: dict):
    names = [c.split()[0] for c in _PIECES.split(", ")]
    cutter = None
    for path, block, data in _records(batches, end):
        rows = []
        if cutter is None or cutter.where != (path, block):
            rows += cutter.end() if cutter else []
            cutter = _Cutter(path, block, begins[path, block])
        rows += cutter.feed(data)
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"opened": "Int64"})
    if cutter:
        yield pd.DataFrame(cutter.end(), columns=names).astype({"opened": "Int64"})


def scan_array(spark: SparkSession, path: str, separator: str = "}") -> DataFrame:
    """(path, field, ord, element): every element as JSON text, numbered from 0 within its array; ``separator``: a character some of which every range holds."""
    text = spark.read.format("text").option("lineSep", separator).load(path)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    end = separator.encode()
    described = rows.mapInPandas(lambda b: _described(b, end), "path string, block long, states array<int>, depths array<long>, first string")
    begins = spark.sparkContext.broadcast(_beginnings(described.collect()))  # one small row a byte range
    pieces = checkpointed(rows.mapInPandas(lambda b: _cut(b, end, begins.value), _PIECES), "pieces")

    # Borders before each range, and the array that is open where it begins.
    ranges = pieces.groupBy("path", "block").agg(F.max("border").alias("borders"), F.max_by(F.struct("opened", "key"), "border").alias("last"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("borders").over(before), F.lit(0)))
    ranges = ranges.withColumn("open", F.when(F.col("last.opened").isNotNull(), F.struct((F.col("base") + F.col("last.opened")).alias("at"), "last.key")))
    ranges = ranges.select("path", "block", "base", F.last("open", True).over(before).alias("carried"))
    own = F.when(F.col("opened").isNotNull(), F.struct((F.col("base") + F.col("opened")).alias("at"), "key"))
    named = pieces.join(ranges, ["path", "block"]).select("path", "block", "part", "edge", "text", (F.col("base") + F.col("border")).alias("number"), F.coalesce(own, "carried").alias("array"))
    # What lies within one range is whole; pieces at a range's ends are joined by their number.
    ends = named.where("edge").groupBy("path", "number").agg(
        F.min_by("array", F.struct("block", "part")).alias("array"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    found = named.where("not edge").select("path", "number", "array", "text").unionByName(ends).where("array.key is not null")
    out = found.select("path", F.col("array.key").alias("field"), (F.col("number") - F.col("array.at")).alias("ord"), F.regexp_replace("text", r"^\s+|\s+\z", "").alias("element"))
    return out.where("element <> ''")
