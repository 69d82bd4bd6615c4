"""Text functions as Column -> Column. Nothing here leaves the JVM.

White space follows Unicode, spelled out for Java's ASCII classes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the Unicode standard, for use inside a class, and the same for patterns that begin with (?U): two tests a character instead of eleven.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
UNICODE_SPACE = r"\s\x1c-\x1f"
BLANKS = "".join(filter(re.compile(f"[{SPACE}]").match, map(chr, range(0x3001))))
#: The ASCII punctuation, and the marks that evaluation also deletes (a space is among them).
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
EVAL_MARKS = ", .!？；:‘’“”[]()《》、—…"
#: English stopwords.
STOPWORDS = (
    "the a an and or but in on at to for of with by from about into through during before after above below under over between among "
    "is are was were be been being have has had having do does did doing will would shall should can could may might must ought i you "
    "he she it we they them their theirs our ours your yours my mine this that these those here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too very s t just don now"
).split()
#: Full-width punctuation and what it becomes.
HALF_WIDTH = {"？": "?", "；": ";", "《": "<", "》": ">", "“": '"', "”": '"', "‘": "'", "’": "'", "、": ",", "～": "~", "－": "-", "—": "-", "　": " "}
#: Adverbs that carry no data.
ADVERBS = "very extremely highly really quite somewhat slightly greatly strongly weakly clearly obviously apparently likely probably possibly".split()


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda's variable is bound, a repeated expression is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[{UNICODE_SPACE}]+", " ")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, rf"(?U)[{UNICODE_SPACE}]+"), lambda w: w != "")


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in PUNCTUATION else c for c in chars) + "]"


def clean(c: Column, whitespace: bool = True, urls: bool = True, lower: bool = True, numbers: bool = False, punctuation: bool = True, stopwords: bool = False, stopword_list: Sequence[str] = STOPWORDS) -> Column:
    """Clean-up in fixed order; a null gives an empty string. Removing a URL may leave two spaces."""
    out = F.coalesce(c, F.lit(""))
    if whitespace:
        out = collapse(out)
    if urls:
        out = F.regexp_replace(out, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", "")
    if lower:
        out = F.lower(out)
    if numbers:
        out = F.regexp_replace(out, r"\d+", "")
    if punctuation:
        out = F.translate(out, PUNCTUATION, "")
    if stopwords:
        out = F.array_join(tokens(out, stopwords=stopword_list), " ")
    return strip(out)


def token_pattern(stopwords: Sequence[str] = STOPWORDS, remove_stopwords: bool = True) -> str:
    """Runs of ASCII letters and digits that are no stopword (matched by case): one pattern, its words grouped by their first letter."""
    if not remove_stopwords or not stopwords:
        return "[a-zA-Z0-9]+"
    first: dict[str, list[str]] = {}
    for w in sorted(set(stopwords)):
        if re.fullmatch("[a-zA-Z0-9]+", w):  # others can be no token
            first.setdefault(w[0], []).append(w[1:])
    return r"(?<![a-zA-Z0-9])(?!(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in first.items()) + r")(?![a-zA-Z0-9]))[a-zA-Z0-9]+"


def tokens(c: Column, remove_stopwords: bool = True, min_length: int = 1, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """ASCII alphanumeric runs; stopwords (the built-in ones, or a list of one's own) are matched by case."""
    found = F.regexp_extract_all(c, F.lit(token_pattern(stopwords, remove_stopwords)), 0)
    return F.filter(found, lambda w: F.length(w) >= min_length) if min_length > 1 else found


def counted(c: Column) -> Column:
    """Of an array of words, the distinct ones as (word, n, first: the place of the first): sorted, each is a run. None for null."""

    def runs(s: Column) -> Column:
        word = lambda i: F.get(s, i)["word"]
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i < F.size(s)) & ((i == 0) | (word(i) != word(i - 1))))
        return let(places, lambda p: F.transform(p, lambda a, k: F.struct(word(a).alias("word"), (F.coalesce(F.get(p, k + 1), F.size(s)) - a).cast("long").alias("n"), F.get(s, a)["pos"].alias("first"))))

    return let(F.sort_array(F.transform(c, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))), runs)


def tokens_cjk(c: Column) -> Column:
    """Runs of Chinese characters or ASCII alphanumerics: segmentation without a dictionary."""
    return F.regexp_extract_all(c, F.lit("[一-龥]+|[a-zA-Z0-9]+"), 0)


def sentences(c: Column, marks: str = ".!?;") -> Column:
    """Non-blank pieces between sentence marks, trimmed."""
    return F.filter(F.transform(F.split(c, f"[{marks}]"), strip), lambda s: s != "")


def count_words(c: Column, use_tokens: bool = True) -> Column:
    return F.regexp_count(c, F.lit(token_pattern() if use_tokens else f"(?U)[^{UNICODE_SPACE}]+"))


def count_sentences(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"(?U)[.!?;{UNICODE_SPACE}]*+[^.!?;]++"))


def count_letters(c: Column) -> Column:
    """ASCII letters and digits: the length of all tokens together."""
    return F.length(F.regexp_replace(c, "[^a-zA-Z0-9]+", ""))


def normalize(c: Column) -> Column:
    """Full-width letters, digits and marks to ASCII, white space collapsed, control characters dropped, trimmed."""
    wide = "".join(chr(k) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for k in range(*r))
    plain = "".join(chr(ord(w) - 0xFEE0) for w in wide)
    out = F.translate(c, wide, plain)
    out = F.replace(F.replace(out, F.lit(", "), F.lit(",")), F.lit("…"), F.lit("..."))
    out = F.translate(out, "".join(HALF_WIDTH), "".join(HALF_WIDTH.values()))
    return strip(F.regexp_replace(collapse(out), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def strip_html(c: Column) -> Column:
    """Delete tags on one line; what scripts and styles contain stays."""
    return F.regexp_replace(c, r"<[^\n]*?>", "")


def eval_normalize(c: Column) -> Column:
    """Tokens for exact match: marks and spaces are deleted, so words only part at tabs and newlines."""
    out = F.lower(F.translate(F.translate(c, PUNCTUATION, ""), EVAL_MARKS, ""))
    return words(out)


def eval_normalize_strict(c: Column) -> Column:
    """The same, with words parted at spaces too."""
    return words(F.lower(F.translate(c, PUNCTUATION + EVAL_MARKS.replace(" ", ""), "")))


def word_set(c: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of lower-cased words; 0 when both are empty."""
    return let(word_set(a), lambda x: let(word_set(b), lambda y: set_jaccard(x, y)))


def set_jaccard(x: Column, y: Column) -> Column:
    """Similarity of two arrays without repeats."""
    sizes = F.struct(F.size(F.array_intersect(x, y)).alias("both"), (F.size(x) + F.size(y)).alias("all"))
    return let(sizes, lambda n: F.when(n["all"] > 0, n["both"] / (n["all"] - n["both"])).otherwise(F.lit(0.0)))


def char_chunks(c: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the last; the last ends the text."""
    step = size - overlap
    n = F.length(c)
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int")
    return F.when(n <= size, F.array(c)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * step + 1, F.lit(size))))


def _state(chunks, current):
    return F.struct(chunks.alias("chunks"), current.alias("current"))


def sentence_chunks(c: Column, size: int = 500, overlap: int = 0) -> Column:
    """Sentences packed greedily into chunks of at most ``size`` characters; a chunk may begin with the last one's tail."""
    start = _state(F.array().cast("array<string>"), F.lit(""))

    def step(acc, s):
        cur = acc["current"]
        full = (F.length(cur) + F.length(s) + 1 > size) & (cur != "")
        tail = F.concat(F.right(cur, F.lit(overlap)), F.lit(" "), s) if overlap else s
        joined = F.when(cur == "", s).otherwise(F.concat(cur, F.lit(" "), s))
        return _state(F.when(full, F.concat(acc["chunks"], F.array(strip(cur)))).otherwise(acc["chunks"]), F.when(full, tail).otherwise(joined))

    def finish(acc):
        return F.when(strip(acc["current"]) == "", acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(strip(acc["current"]))))

    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.aggregate(sentences(c), start, step, finish))


def token_chunks(c: Column, size: int = 500, overlap: int = 0) -> Column:
    """Tokens packed greedily; each counts its length and a space. The overlap is made of whole tokens."""
    start = _state(F.array().cast("array<string>"), F.lit(""))

    def tail(current):
        """The longest run of last tokens that counts at most the overlap: cut at the first space of that many last characters."""
        if not overlap:
            return F.lit("")
        return F.when(F.length(current) < overlap, current).otherwise(F.regexp_replace(F.right(current, F.lit(overlap)), r"^[^ ]*( |\z)", ""))

    def step(acc, t):
        cur = acc["current"]
        full = (F.length(cur) + F.length(t) + 2 > size) & (cur != "")
        kept = F.when(full, tail(cur)).otherwise(cur)
        return _state(F.when(full, F.concat(acc["chunks"], F.array(cur))).otherwise(acc["chunks"]), F.when(kept == "", t).otherwise(F.concat(kept, F.lit(" "), t)))

    def finish(acc):
        return F.when(acc["current"] == "", acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(acc["current"])))

    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.aggregate(tokens(c), start, step, finish))


def justify(line: Column, width: int) -> Column:
    """Spread a line to the width; what doesn't divide goes to the leftmost gaps. One word stays as it is."""
    w = words(line)
    gaps = F.size(w) - 1
    room = F.lit(width) - F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    each, extra = F.floor(room / gaps).cast("int"), F.pmod(room, gaps)
    padded = F.transform(w, lambda x, i: F.when(i < gaps, F.concat(x, F.repeat(F.lit(" "), each + (i < extra).cast("int")))).otherwise(x))
    return F.when(gaps < 1, line).otherwise(F.array_join(padded, ""))


def wrap(c: Column, width: int = 80, justified: bool = False) -> Column:
    """Greedy line wrapping; a first word longer than the line leaves an empty line before it."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("current"))

    def step(acc, w):
        cur = acc["current"]
        full = F.length(cur) + F.length(w) + F.when(cur == "", 0).otherwise(1) > width
        line = justify(cur, width) if justified else cur
        return F.struct(
            F.when(full, F.concat(acc["lines"], F.array(line))).otherwise(acc["lines"]).alias("lines"),
            F.when(full, w).when(cur == "", w).otherwise(F.concat(cur, F.lit(" "), w)).alias("current"),
        )

    def finish(acc):
        return F.array_join(F.when(acc["current"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["current"]))), "\n")

    return F.aggregate(words(c), start, step, finish)


def entities(c: Column) -> Column:
    """Distinct capitalised words, capital runs and Chinese runs, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]+|[A-Z]+|[一-龥]+"), 0)))


def drop_descriptive(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\b(?:{'|'.join(ADVERBS)})\b", "")


def is_vector_text(c: Column) -> Column:
    """Whether a text is a bracketed list of plain non-negative decimals."""
    s = rf"[{SPACE}]*"
    return c.rlike(rf"^{s}\[{s}([0-9]+(\.[0-9]+)?{s},{s})*[0-9]+(\.[0-9]+)?{s}\]{s}\z")


def valid_query(c: Column) -> Column:
    """At least two characters after trimming; null is invalid."""
    return F.coalesce(F.length(strip(c)) >= 2, F.lit(False))


def is_image_path(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp)\z"), F.lit(False))


def image_path(c: Column) -> Column:
    """The path without an ``image:`` prefix, null if it is no image path."""
    bare = strip(F.regexp_replace(c, "^image:", ""))
    return F.when(is_image_path(bare), bare)


def rewrite_path(c: Column, root: str) -> Column:
    """A path under ./data moved to the configured root."""
    return F.regexp_replace(c, r"^\./data(?=/|\z)", root.rstrip("/"))


def first_of(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
