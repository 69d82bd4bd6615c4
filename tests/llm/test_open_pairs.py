"""The join of open postings against all pairs, and long near copies that aren't linked."""

import os

import numpy as np
import pandas as pd

from hopweave.llm import ngram_join


def test_no_pair_that_can_be_similar_is_missed():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for _ in range(30):
            m = int(rng.integers(2, 400))
            x = pd.DataFrame({"tok": rng.integers(0, max(2, m // 25), m), "rep": rng.integers(0, m, m)}).drop_duplicates()
            n = rng.integers(5, 60, m)
            x = x.assign(t1=0, t2=0, own=0, comp=x["rep"] // 2, n=n[x["rep"]], ell=1 + x["rep"] % 3)
            x["pos"] = [int(rng.integers(0, max(1, k // 3))) for k in x["n"]]
            x = x.sort_values("tok").reset_index(drop=True)
            size = int(rng.integers(1, 50))
            got = pd.concat([*ngram_join._met((x[s : s + size] for s in range(0, len(x), size)), percent)] or [pd.DataFrame(columns=["a", "b", "k", "ell"])])
            got = got.groupby(["a", "b"]).agg(k=("k", "sum"), ell=("ell", "min"))
            want = {}
            for _, g in x.groupby("tok"):
                rows = g.to_dict("records")
                for i, r in enumerate(rows):
                    for s in rows[:i]:
                        ell = min(r["ell"], s["ell"])
                        most = min(r["n"] - r["pos"], s["n"] - s["pos"]) + ell - 1
                        sized = 100 * min(r["n"], s["n"]) >= percent * max(r["n"], s["n"])
                        if r["comp"] != s["comp"] and sized and most * 100 >= (r["n"] + s["n"] - most) * percent:
                            key = (min(r["rep"], s["rep"]), max(r["rep"], s["rep"]))
                            want[key] = want.get(key, 0) + 1
            assert {k: v for k, v in got["k"].items()} == want


def test_long_near_copies_write_less_than_their_text(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [str(x) for x in rng.integers(0, 10**9, 60_000)]
    other = list(words)
    for k in rng.choice(60_000, 1_230, replace=False):
        other[k] = str(rng.integers(0, 10**9))
    texts = [" ".join(words), " ".join(other)]
    written, plain = {}, ngram_join.dropped

    def spy(*tables):
        for t in tables:
            path = getattr(t, "_hopweave_path", None)
            if path:
                written[path] = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
        plain(*tables)

    monkeypatch.setattr(ngram_join, "dropped", spy)
    got = ngram_join.join_components(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 3, 90).collect()
    a, b = (ngram_join.shingles(t, 3) for t in texts)
    shared = len(np.intersect1d(a, b))
    assert 85 * (len(a) + len(b) - shared) < 100 * shared < 90 * (len(a) + len(b) - shared)
    assert sorted(r["component_id"] for r in got) == [0, 1]
    assert sum(written.values()) < 4 * sum(map(len, texts))


def test_unlinked_copies_of_one_passage(spark):
    rng = np.random.default_rng(1)
    passages = [" ".join(str(x) for x in rng.integers(0, 10**9, 300)) for _ in range(2)]
    rows = [(i, passages[i >= 380] + " " + " ".join(map(str, rng.integers(0, 10**9, 20 if i < 380 else 5)))) for i in range(400)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert all(got[i] == i for i in range(380))
    assert all(got[i] == 380 for i in range(380, 400))
