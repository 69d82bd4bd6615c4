"""Compression of OCR text: noise, chunks, near duplicates, budgets, precision extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.text import UNICODE_SPACE, count_words, drop_descriptive, entities, let, sentences, set_jaccard, strip, word_set, words

#: Characters that only OCR produces in runs; the units that may follow a number.
NOISE = "│━─—§¶×®©"
NUMBER = r"\$?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:%|million|billion|kg|mm|°C|kW)?"


def _at_least(n: int) -> str:
    """A pattern of texts with n words; it reads no further."""
    return rf"(?U)\A[{UNICODE_SPACE}]*+(?:[^{UNICODE_SPACE}]++[{UNICODE_SPACE}]++){{{n - 1}}}[^{UNICODE_SPACE}]"


#: A list marker at the start of a line: "1.", "A)", "(A)" or an ideographic comma.
MARKER = r"\n\s*(?:\d+\.|\(?[A-Z]\)|、)"


def clean_lines(docs: DataFrame, id_: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """Of (id, text) with the columns to keep: drop runs of noise and lines seen three times, short lines and those of under three words; keep texts of which over 30 % of the words are left."""
    bare = F.regexp_replace("text", f"[{NOISE}]{{5,}}", "")

    def often(lines: Column) -> Column:
        """Sorted, a line seen three times stands two places after itself."""
        return let(F.sort_array(lines), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 2) == x, F.lit(False)))))

    def good(lines: Column) -> Column:
        return let(often(lines), lambda o: F.filter(lines, lambda x: x.rlike(_at_least(3)) & (F.length(strip(x)) > 10) & ~F.array_contains(o, x)))

    kept = lambda b: let(let(F.split(b, "\n"), good), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")))
    row = let(bare, lambda b: let(kept(b), lambda t: F.struct(t.alias("text"), count_words(t, use_tokens=False).cast("long").alias("n_left"), count_words(b, use_tokens=False).cast("long").alias("n_words"))))
    # As a generator, the row is made once; a filter would be pushed down and make it anew.
    fits = F.filter(F.array(row), lambda r: (r["n_words"] > 0) & (r["n_left"] / r["n_words"] > 0.3))
    return docs.select(id_, *keep, F.inline(fits))


def sentence_windows(text: Column, n: int = 5) -> Column:
    """Runs of ``n`` sentences, joined by a full stop and a space."""
    last = lambda s: F.greatest(F.ceil(F.size(s) / n).cast("int") - 1, F.lit(0))
    return let(sentences(text), lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda i: F.array_join(F.slice(s, i * n + 1, F.lit(n)), ". ")))


def chunks(text: Column, size: int = 300, windows: int = 0) -> Column:
    """Sections at list markers (over 50 words each); with under two markers, pieces of ``size`` characters, or windows of so many sentences."""
    pieces = sentence_windows(text, windows) if windows else F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0)  # one pass; substrings are counted from the start
    big = lambda parts: F.transform(F.filter(parts, lambda p: p.rlike(_at_least(51))), strip)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(let(F.split(text, MARKER), lambda parts: F.when(F.size(parts) < 3, pieces).otherwise(big(parts))))


def coherent(text: Column) -> Column:
    """Without a language model: more than ten words."""
    return text.rlike(_at_least(11))


def near_distinct(texts: Column, limit: Column | float = 0.9, most: int = 10) -> Column:
    """Greedy choice from an ordered array: keep what is at most ``limit`` similar to all kept before, up to the first ``most`` kept."""
    paired = F.transform(texts, lambda t: F.struct(t.alias("t"), word_set(t).alias("w")))
    kept = F.aggregate(
        paired, F.array().cast("array<struct<t:string,w:array<string>>>"),
        lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: set_jaccard(k["w"], x["w"]) > limit), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(kept, lambda k: k["t"])


def ranked_distinct(texts: Column, scores: Column | None = None, limit: Column | float = 0.9, most: int = 10) -> Column:
    """near_distinct() of texts by falling score, equal ones in their order; without scores (no model) in their order."""
    if scores is None:
        return near_distinct(texts, limit, most)
    order = F.array_sort(F.transform(F.arrays_zip(texts.alias("t"), scores.alias("s")), lambda x, i: F.struct((-x["s"]).alias("s"), i.alias("i"), x["t"].alias("t"))))
    return near_distinct(F.transform(order, lambda x: x["t"]), limit, most)


def budget(ranked: DataFrame, target: int, key: str = "question_id", order: str = "rank", text: str = "text", worth: int = 100) -> DataFrame:
    """Chunks while their words fit the target; the first that doesn't is cut to what is left if that is over ``worth`` words."""
    n = ranked.withColumn("n_words", F.size(words(F.col(text))).cast("long"))
    total = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = n.withColumn("so_far", F.sum("n_words").over(total))
    # Sums only grow: one before was over the target if the sum without this chunk is.
    left = F.lit(target) - (F.col("so_far") - F.col("n_words"))
    cut = F.col("so_far") > target
    kept = run.where(left >= 0).where(~cut | (left > worth))
    short = F.array_join(F.slice(words(F.col(text)), F.lit(1), F.greatest(left, F.lit(1)).cast("int")), " ")
    return kept.withColumn("truncated", cut).withColumn(text, F.when(cut, short).otherwise(F.col(text))).withColumn("n_words", F.when(cut, left).otherwise(F.col("n_words"))).drop("so_far")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def surroundings(text: Column, word: Column, around: int = 100) -> Column:
    """Every occurrence of a word, whatever its case, with the characters on both sides; windows may overlap."""
    pieces = F.split(text, F.concat(F.lit("(?i)\\Q"), word, F.lit("\\E")), -1)
    ends = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p) + F.length(word))),
    )

    def window(end: Column) -> Column:
        start = F.greatest(end - F.length(word) - around, F.lit(0))
        return F.substring(text, start + 1, end + around - start)

    return F.transform(ends, window)


def precision_extract(query: Column, text: Column, most_words: int = 2000, around: int = 100) -> Column:
    """Numbers, table and page contexts and the surroundings of the query's entities, one per line.

    Tables give the line of their marker with up to 500 characters after it. An extract over ``most_words``
    loses its descriptive adverbs.
    """
    # What marks tables, figures and pages.
    tables = F.regexp_extract_all(text, F.lit(r"(?s)(?:Table|Figure)\s*\d+[^\n]*\n.{0,500}"), 0)
    pages = F.regexp_extract_all(text, F.lit(r"Page\s+\d+[^\n]*\n[^\n]{0,300}"), 0)
    found = F.array_join(F.concat(numbers(text), tables, pages, F.flatten(F.transform(entities(query), lambda e: surroundings(text, e, around)))), "\n")
    return F.when(F.size(words(found)) > most_words, drop_descriptive(found)).otherwise(found)


def compress(docs: DataFrame, query: str | Column, target: int = 2000, limit: float = 0.9, score=None) -> DataFrame:
    """Noise, chunks, relevance, near duplicates and budget in one: one row per kept chunk of each document, the most relevant first.

    query: what is asked, the same for all documents or a column of them. score(query, chunk): a column, by default
    the similarity of both sets of words (a reranking model's stand-in); chunks of equal score stay in their order.
    """
    asked = docs.select("doc_id", "text", (F.lit(query) if isinstance(query, str) else query).alias("query"))
    cut = clean_lines(asked, keep=("query",)).select("doc_id", "query", chunks(F.col("text")).alias("c"))
    if score is None:
        worth = let(word_set(F.coalesce("query", F.lit(""))), lambda q: F.transform("c", lambda x: let(word_set(x), lambda w: set_jaccard(q, w))))
    else:
        worth = F.transform("c", lambda x: score(F.col("query"), x))
    kept = cut.select(F.col("doc_id").alias("question_id"), "query", F.posexplode(ranked_distinct(F.col("c"), worth, limit)).alias("rank", "text"))
    return budget(kept, target).withColumnRenamed("question_id", "doc_id")
