"""How much padding packing leaves, on short and on long documents."""

import numpy as np
import public_tokenizers as P
import pytest

from hopweave.llm import packing


@pytest.mark.parametrize("least, most, n", [(20, 140, 4_000), (3, 12, 6_000), (200, 3_000, 300)])
def test_little_padding(spark, least, most, n):
    rng = np.random.default_rng(least)
    words = ["the", "cat", "sat", "on", "a", "mat", "with", "seven", "curious", "friends"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(least, most)))) for i in range(n)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), P.path("word_bpe_49k.json"))
    used = got.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].to_numpy()
    power = (used & (used - 1)) == 0
    padding = np.where(power, 0, 4096 - used).sum()
    assert padding <= 0.01 * used.sum() + 4096 * (len(used) < 50), (padding, used.sum(), len(used))


def test_classes_follow_the_lengths():
    assert packing.units({1000: 50, 3000: 20}, 4096, 32) == 16
    assert packing.units({k: 10 for k in range(20, 140)}, 4096, 32) in (2, 4)
    assert packing.units({k: 10 for k in range(3, 12)}, 4096, 32) == 1
    assert packing.units({}, 4096, 32) == 16
    for unit in (1, 2, 4, 8, 16):
        for length in range(1, 4097):
            c = packing.rounded(length, unit, 4096)
            assert length <= c * unit <= 4096
