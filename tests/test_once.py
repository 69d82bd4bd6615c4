"""Costly parts of text functions are made once a text, and long texts take time with their length."""

import time

from pyspark.sql import functions as F

from hopweave.functions import text
from hopweave.operators import ocr


def seconds(df):
    begin = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - begin


def test_white_space_under_the_unicode_flag(spark):
    d = spark.createDataFrame([(chr(i),) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000], "c string")
    old, new = F.col("c").rlike(f"[{text.SPACE}]"), F.col("c").rlike(f"(?U)[{text.UNICODE_SPACE}]")
    assert d.where(old != new).count() == 0 and d.where(new).count() == 29
    got = spark.createDataFrame([("a　b\x1cc d  e ​f",)], "t string").select(text.count_words(F.col("t"), False), text.words(F.col("t")), text.collapse(F.col("t"))).first()
    assert got[0] == 6 and list(got[1]) == ["a", "b", "c", "d", "e", "​f"] and got[2] == "a b c d e ​f"


def test_f4_sentences_are_split_once_for_all_windows(spark):
    assert str(ocr.sentence_windows(F.col("t"))).count("split(") == 1
    long = spark.range(1).select(F.repeat(F.lit("One two. "), 20_000).alias("t"))
    got = long.select(ocr.sentence_windows(F.col("t")).alias("w")).first()["w"]
    assert len(got) == 4_000 and {*got} == {". ".join(["One two"] * 5)}
    assert seconds(long.select(ocr.sentence_windows(F.col("t")))) < 10  # each window split the text anew


def test_f3_chunks_are_cut_in_one_pass(spark):
    assert "substring" not in str(ocr.chunks(F.col("t"))) and str(ocr.chunks(F.col("t"))).count("split(") == 1
    d = spark.createDataFrame([("é😀\n" * 250,), ("",), (None,), ("x" * 300,), ("x" * 301,)], "t string")
    got = [r[0] for r in d.select(ocr.chunks(F.col("t"))).collect()]
    t = "é😀\n" * 250
    assert [list(g) if g is not None else None for g in got] == [[t[:300], t[300:600], t[600:]], [], None, ["x" * 300], ["x" * 300, "x"]]
    listed = "\n1. " + "w " * 50 + "\n2. " + "w " * 51 + "\n3. y"
    assert spark.createDataFrame([(listed,)], "t string").select(ocr.chunks(F.col("t"))).first()[0] == [("w " * 51).strip()]


def test_f2_word_sets_are_made_once_a_chunk(spark):
    assert str(text.jaccard(F.col("a"), F.col("b"))).count("split(") == 2
    got = spark.createDataFrame([("a b", "b c"), ("", " "), (None, "a")], "a string, b string").select(text.jaccard(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 1 / 3 and got[1][0] == 0.0


def test_f5_noise_is_dropped_once(spark):
    d = spark.createDataFrame([(1, "─────one two three four\nshort\n" + "the same line again\n" * 3 + "five six seven eight"), (2, None), (3, "")], "doc_id long, text string")
    plan = ocr.clean_lines(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [tuple(r) for r in ocr.clean_lines(d).collect()] == [(1, "one two three four\nfive six seven eight", 8, 21)]
