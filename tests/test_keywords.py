"""Segmentation against exhaustive search, TextRank against a plain iteration, tf-idf on odd rows."""

import itertools
import math
import random

import pytest

from hopweave.functions import segment
from hopweave.operators import keywords


def test_the_cheapest_of_all_segmentations():
    rng = random.Random(2)
    for _ in range(300):
        counts = {"".join(rng.choices("中文分词很", k=rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))}
        d = segment.Dictionary(counts)
        total = sum(counts.values())
        text = "".join(rng.choices("中文分词很X", k=rng.randrange(0, 9)))

        def cost(parts):
            if any(p not in counts and len(p) > 1 for p in parts):
                return math.inf
            return sum(-math.log(counts[p] / (total + segment.UNKNOWN)) if p in counts else d.unknown for p in parts)

        n = len(text)
        every = [[text[a:b] for a, b in zip((0, *cuts), (*cuts, n))] for r in range(n) for cuts in itertools.combinations(range(1, n), r)] if n else [[]]
        got = d.cut(text)
        assert "".join(got) == text and abs(cost(got) - min(map(cost, every))) < 1e-9


def test_segmented_column(spark):
    words = spark.createDataFrame([("北京", 30), ("北京大学", 10), ("大学", 20), ("学生", 25), ("生活", 9), ("", 4), (None, 4)], "word string, n long")
    docs = spark.createDataFrame([(1, "北京大学生活, hello 42!"), (2, None), (3, ""), (4, "学生。大学"), (5, "未知词")], "doc_id long, text string")
    got = {r["doc_id"]: r["words"] for r in segment.segmented(docs, words).collect()}
    assert got == {1: ["北京大学", "生活", "hello", "42"], 2: None, 3: [], 4: ["学生", "大学"], 5: ["未", "知", "词"]}


def test_a_large_dictionary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(segment, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        segment.segmented(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([(c, 1) for c in "abc"], "word string, n long"))


def test_text_rank_is_that_of_a_plain_iteration():
    rng = random.Random(4)
    for _ in range(60):
        words = rng.choices("abcdefgh", k=rng.randrange(0, 40))
        names, got = keywords.ranked_words(words, span=4, rounds=7)
        graph = {}
        for i in range(len(words)):
            for j in range(i + 1, min(i + 4, len(words))):
                if words[i] != words[j]:
                    for a, b in ((words[i], words[j]), (words[j], words[i])):
                        graph[a, b] = graph.get((a, b), 0) + 1
        out = {a: sum(w for (x, _), w in graph.items() if x == a) for a in names}
        rank = {a: 1 / len(names) for a in names}
        for _ in range(7):
            rank = {a: 0.15 + 0.85 * sum(w * rank[x] / out[x] for (x, y), w in graph.items() if y == a) for a in names}
        assert all(abs(rank[a] - r) < 1e-9 for a, r in zip(names, got))


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (None, ["a"]), (4, ["a"] * 50 + ["c"]), (5, ["b"])], "doc_id long, words array<string>")
    for frequent in (1, 1_000):  # all words by shuffle; all by broadcast
        monkeypatch.setattr(keywords, "FREQUENT", frequent)
        got = {(r["doc_id"], r["rank"]): (r["word"], r["weight"]) for r in keywords.tf_idf(docs, 2).collect()}
        assert got[1, 1] == ("a", round(2 / 3 * (math.log(6 / 3) + 1), 6)) and got[5, 1][0] == "b" and set(got) == {(1, 1), (1, 2), (4, 1), (4, 2), (5, 1)}
    ranks = {(r["doc_id"], r["word"]): r["weight"] for r in keywords.text_rank(docs).collect()}
    assert ranks[5, "b"] == 0.15 and ranks[1, "a"] == ranks[1, "b"] and (2, "a") not in ranks


def test_a_dictionary_of_any_size_in_pieces(spark, monkeypatch):
    """Over MOST_WORDS, read in several pieces, in several blocks; words on both sides of the gate, beside each other's beginnings."""
    rng = random.Random(5)
    counts = {"".join(rng.choices("ab中", k=rng.randrange(1, 12))): rng.randrange(1, 9) for _ in range(400)}
    texts = ["".join(rng.choices([*counts, "x", "😀"], k=rng.randrange(1, 30))) for _ in range(60)]
    want = [segment.Dictionary(counts).cut(t) for t in texts]
    monkeypatch.setattr(segment, "MOST_WORDS", 2)
    monkeypatch.setattr(segment, "PIECE", 90)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["words"] for r in segment.segmented(docs, words, runs=r"\S+", others="", limited=False).collect()}
    assert [got[i] for i in range(len(texts))] == want and all("".join(w) == t for w, t in zip(want, texts))


def test_f6_words_are_counted_without_python(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (None, ["a"])], "doc_id long, words array<string>")
    counted = keywords.counted(docs)
    assert "MapInPandas" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == [(1, "a", 1, 3), (1, "b", 2, 3)]
