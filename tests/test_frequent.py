"""The most frequent tokens, counted within rows, against a plain count; rows that share an id count together."""

import random
from collections import Counter

from hopweave.plans.text_queries import frequent


def test_f11_f12_no_token_is_shuffled(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("aa b1 C dd e f g h i9 j k l m".split(), k=rng.randrange(0, 60)))) for i in range(50)] + [(50, None), (51, "")]
    got = frequent(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append((r["rank"], r["word"], r["n"], r["total"]))
    for i, t in rows:
        words = (t or "").split()
        words = [w for w in words if w != "i"]
        best = Counter(words).most_common(10)  # equal counts in order of the first
        assert sorted(found.get(i, [])) == [(k + 1, w, n, len(words)) for k, (w, n) in enumerate(best)]


def test_rows_that_share_an_id_count_together(spark):
    rows = [(1, "aa bb bb"), (1, "aa aa cc"), (2, "dd"), (None, "ee"), (None, "ee ff")]
    got = sorted(((r["doc_id"] or 0, r["rank"], r["word"], r["n"]) for r in frequent(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 1, "ee", 2), (0, 2, "ff", 1), (1, 1, "aa", 3), (1, 2, "bb", 2), (1, 3, "cc", 1), (2, 1, "dd", 1)]
