"""Runs of words and the band join against brute force, with all edge cases."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import band_join, runs


def brute_runs(w, least=24, periods=3):
    """Every maximal repetition, by comparing all words at every distance."""
    found, taken = [], set()
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, periods * q) and (i, length) not in taken:  # a multiple of the smallest period has the same range
                taken.add((i, length))
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    texts = [[], ["a"], ["a"] * 100, list("ab" * 40), list("abc" * 30 + "x" + "abc" * 30), list("aab" * 9 + "aa" * 20 + "b" + "ba" * 15)]
    for k in range(150):
        base = [str(x) for x in rng.integers(0, 2 + k % 5, rng.integers(0, 60))]
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(base) + 1))
            base[at:at] = [str(x) for x in rng.integers(0, 3, rng.integers(1, 9))] * int(rng.integers(1, 9))
        texts.append(base)
    for least, periods in ((24, 3), (6, 2), (9, 3)):
        got = [[tuple(map(int, r)) for r in f] for f in runs.runs(texts, least, periods)]
        assert got == [brute_runs(t, least, periods) for t in texts]
        assert sum(map(len, got)) > 50


def test_long_texts():
    assert runs.runs([["x"] * 200_000])[0].tolist() == [[0, 200_000, 1]]
    words = [str(k) for k in range(50_000)] * 3 + ["end"]
    assert runs.runs([words, ["z"] * 30])[0].tolist() == [[0, 150_000, 50_000]]


def test_runs_query(spark):
    texts = [None, "", " \t ", "one", "w " * 40, "a b c d " * 20 + "tail", "été " * 30, "a\x0bb\x0cc\r\nd " * 10, "a a " * 30, " ".join(map(str, range(500)))] * 20
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "w " * 40, 1, "x"), (4, "w " * 40, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, start string").repartition(3)
    got = runs.find_runs(runs.rewritten(docs)).withColumn("best", runs.strongest(F.col("runs"))).collect()
    assert len(got) == len(rows)
    want = {}
    changed = 0
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
            changed += 1
        found = brute_runs(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in found)]
        want.setdefault(i, []).append((found, best, b" ".join(kept).decode()))
    assert changed > 10
    for r in got:
        best = (r["best"]["start"], r["best"]["length"], r["best"]["period"]) if r["best"] else None
        mine = ([(x["start"], x["length"], x["period"]) for x in r["runs"]], best)
        hits = [w for w in want[r["doc_id"]] if (w[0], w[1]) == mine]
        # A text without a word to rewrite keeps its white space only where nothing collapses it.
        assert hits and " ".join(r["collapsed"].split(" ")) == hits[0][2], r
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_runs_columns(spark):
    out = runs.op11_runs(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = out.collect()
    assert any(r["n_runs"] for r in rows) and all((r["n_runs"] == 0) == (r["start"] is None) for r in rows)
    assert all(r["runs_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if not r["n_runs"])
    assert all(r["exponent_milli"] == 1000 * r["length"] // r["period"] >= 3000 for r in rows if r["n_runs"])


def brute_band(lines, items, k=10):
    pairs = []
    for s, n, i, q, a in lines:
        if None in (s, i, q, a) or q == 0 or not abs(a) < 4e16:
            continue
        cents = int(np.floor(100 * a + 0.5))
        pairs.append(((2 * cents + q) // (2 * q), s, n, i, zlib.crc32(f"{s},{'' if n is None else n},{i}".encode())))
    out = []
    for i, price in items:
        p = int(np.floor(100 * price + 0.5)) if i is not None and price is not None and abs(price) < 4e16 else None
        hits = [(abs(u - p), u, s, -1 if n is None else n, x, c) for u, s, n, x, c in pairs if x != i and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * min(u, p))] if p is not None else []
        hits.sort()
        sums = (len(hits), sum(h[0] for h in hits), sum(h[5] for h in hits))
        out += [(i, r + 1, *h[:5], *sums) for r, h in enumerate(hits[:k])] or [(i, 0, *[None] * 5, 0, 0, 0)]
    return sorted(map(str, out))


LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, u string, b int"
ITEMS = "item_id long, price double, p string, s int"


@pytest.mark.parametrize("hot", [2, 2_000])
def test_band_join_is_that_of_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    lines = []
    for k in range(1500):
        x = int(rng.integers(0, 25)) if rng.random() > 0.35 else 3  # one item has a third of the lines
        q = int(rng.integers(1, 6))
        lines.append((int(rng.integers(0, 300)), int(rng.integers(1, 4)), x, q, round(float(rng.choice([4.0, 9.9, 150.0, 12_345.0, 9_999.99, 250_000.0]) * q * rng.uniform(0.97, 1.03)), 2)))
    lines += lines[:40] + [(None, 1, 1, 1, 4.0), (1, 1, None, 1, 4.0), (1, 1, 1, None, 4.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 4.0), (1, 1, 1, 1, float("nan")), (1, 1, 1, 1, float("inf")), (1, None, 1, 1, 4.0), (1, 2, 5, 1, -4.0), (1, 2, 5, -3, 4.0), (2, 1, 9, 1, 1e300), (2, 1, 9, 1, 3e15)]
    items = [(i, float(rng.choice([4.0, 9.9, 150.3, 12_345.6, 10_000.0, 251_000.0]))) for i in range(30)] + [(3, 4.0), (3, 4.0), (70, None), (None, 4.0), (71, float("nan")), (72, -4.0), (73, 0.0), (74, 3e15), (75, 77.0), (76, 5e16)]
    a = spark.createDataFrame([(*r, "z", 1) for r in lines], LINES).repartition(4)
    b = spark.createDataFrame([(*r, "z", 1) for r in items], ITEMS)
    found = band_join.band_join(a, b, hot=hot).select("item_id", F.posexplode_outer("nearest").alias("i", "l"), "n_pairs", "gap_sum", "lines_crc").select("item_id", F.coalesce(F.col("i") + 1, F.lit(0)), "l.*", "n_pairs", "gap_sum", "lines_crc").collect()
    got = sorted(str(tuple(-1 if k == 5 and v is None and r[1] else v for k, v in enumerate(r))) for r in found)
    assert got == brute_band(lines, items)


def test_band_join_of_empty_tables(spark):
    none, some = spark.createDataFrame([], LINES), spark.createDataFrame([(1, 4.0, "z", 1)], ITEMS)
    assert band_join.band_join(none, some).collect()[0]["n_pairs"] == 0
    assert band_join.band_join(none, some.limit(0)).count() == 0


def test_bucket_numbers_rise_without_gaps(spark):
    edges = sorted({int(x) + d for z in range(5, 12) for x in np.linspace(10**z, 10 ** (z + 1), 400) for d in (-1, 0, 1)} | set(range(-500, 500)))
    got = [r["b"] for r in spark.createDataFrame([(e,) for e in edges], "u long").select("u", band_join.bucket(F.col("u")).alias("b")).orderBy("u").collect()]
    assert got == sorted(got)
    joined = spark.createDataFrame([(10 ** z + d,) for z in range(6, 12) for d in (-1, 0)], "u long").select(band_join.bucket(F.col("u")).alias("b")).orderBy("b").collect()
    assert all(b["b"] == a["b"] + 1 for a, b in zip(joined[::2], joined[1::2]))
