"""Parsers of what language models return, and of question structure, as Column -> Column."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hopweave.functions.text import SPACE, strip

#: Answers that say nothing, lower-cased.
UNHELPFUL = (
    "no specific information available", "no information available", "i don't know", "i'm not sure", "it's not specified",
    "not mentioned", "no answer available", "no answer generated",
)
#: Names of the hop types 1 to 5.
HOP_TYPES = ("Single-hop", "Parallel 2-hop", "Bridge 2-hop", "Parallel 3+ hop", "Bridge 3+ hop")


def confidence(c: Column) -> Column:
    """The last ``Score: x`` outside thinking blocks, clamped to [0, 1]; null without one."""
    text = F.replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), F.lit("**"), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(rf"(?i)Score:[{SPACE}]*(\d+(?:\.\d+)?)"), 1)
    score = F.try_element_at(found, F.lit(-1)).cast("double")
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def needs_retrieval(score: Column, threshold: float = 0.9) -> Column:
    return F.coalesce(score, F.lit(0.0)) < threshold


def strategy(reply: Column) -> Column:
    """The retrieval strategy a reply names; text retrieval when it names none."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    return F.when(F.contains(low, F.lit("cross_modal")), "cross_modal").when(F.contains(low, F.lit("hybrid")), "hybrid").otherwise("local_text")


def modality_complexity(images: Column) -> Column:
    """1 without images, 2 with one, 3 with more."""
    return F.least(F.coalesce(F.size(images), F.lit(0)), F.lit(2)) + 1


def _items(c: Column, mark: str) -> Column:
    return F.size(F.filter(F.split(c, mark), lambda s: strip(s) != ""))


def parallel_hops(c: Column) -> Column:
    """1, 2 or 4: single, two parallel items, three or more."""
    low = F.lower(c)
    part = strip(F.element_at(F.split(low, "compare the"), -1))
    listed = _items(F.replace(F.element_at(F.split(part, " of "), -1), F.lit(" and "), F.lit(",")), ",")
    has = lambda s: F.contains(low, F.lit(s))
    compared = F.when(F.contains(part, F.lit(" of ")), listed).otherwise(0)
    n = F.when(has("compare") | has("comparison"), compared).when(F.contains(c, F.lit("、")), _items(c, "、")).when(F.contains(c, F.lit(",")), _items(c, ",")).otherwise(0)
    return F.when(n >= 3, 4).when(n == 2, 2).otherwise(1)


def hop_type(n: Column) -> Column:
    out = F.lit("Unknown type")
    for k, name in enumerate(HOP_TYPES, 1):
        out = F.when(n == k, name).otherwise(out)
    return out


def planner_route(n: Column) -> Column:
    return F.when(n == 1, "simple_direct").when(n.isin(2, 4), "parallel").otherwise("bridge")


def route(hops: Column) -> Column:
    """Routing by multi-hop complexity, which may be a string; what is no number counts as 3."""
    n = F.coalesce(hops.try_cast("int"), F.lit(3))
    return F.when(n == 1, "no_decomposition").when(n.isin(2, 4), "parallel_processing").otherwise("bridge_processing")


def processing_type(routing: Column) -> Column:
    return F.when(routing == "no_decomposition", "direct").when(routing == "parallel_processing", "parallel").otherwise("bridge")


def judged_accuracy(reply: Column) -> Column:
    """1.0 if the first digit of a judge's reply is 4 or more, else 0.0."""
    return F.when(F.coalesce(F.regexp_extract(reply, r"(\d)", 1), F.lit("")).try_cast("int") >= 4, 1.0).otherwise(0.0)


def clean_answer(c: Column) -> Column:
    """Mark-up and lists to plain text; an answer that says nothing becomes empty."""
    out = F.regexp_replace(c, r"\*\*([^\n]*?)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^\n]*?)\*", "$1")
    out = F.regexp_replace(out, rf"(?m)^[{SPACE}]*[-*+][{SPACE}]+", "")
    out = strip(F.regexp_replace(out, rf"[{SPACE}]+", " "))
    return F.when(F.lower(out).isin(*UNHELPFUL), "").otherwise(out)


def json_text(c: Column) -> Column:
    """The text of a hit that may be JSON: an object's text, or the texts of an array's objects."""
    v = F.try_parse_json(c)
    looks = strip(c).rlike(r"^[{\[]")
    kind = F.schema_of_variant(v)
    obj = F.coalesce(F.try_variant_get(v, "$.text", "string"), c)
    arr = F.array_join(F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), " ")
    return F.when(~looks | v.isNull(), c).when(F.startswith(kind, F.lit("OBJECT")), obj).when(F.startswith(kind, F.lit("ARRAY")), arr).otherwise(c)


def corpus_text(c: Column) -> Column:
    """The text of a JSON corpus file: an object's, an array's joined by spaces, a scalar; null if malformed."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    item = lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))).otherwise(F.try_variant_get(x, "$", "string"))
    arr = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), " ")
    obj = F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))
    return F.when(F.startswith(kind, F.lit("OBJECT")), obj).when(F.startswith(kind, F.lit("ARRAY")), arr).otherwise(F.try_variant_get(v, "$", "string"))


_FENCE = re.compile(r"```(?:json)?")
_LINE_COMMENT = re.compile(r"(?<![:\"'])//[^\n]*")
_TRAILING = re.compile(r",\s*([}\]])")


def objects_in(text: str) -> list[str]:
    """All balanced top-level {...} parts, braces inside strings not counted."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = depth > 0
        elif ch == "{":
            if depth == 0:
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def repaired(text: str | None) -> str | None:
    """A JSON object out of a model's reply, re-serialised; null if none can be read.

    Tried in turn: the reply, the longest balanced object, and each without comments, trailing commas and
    single quotes.
    """
    if not text:
        return None
    bare = _FENCE.sub("", text).strip()
    tries = [bare, *sorted(objects_in(bare), key=len, reverse=True)]
    for t in list(tries):
        fixed = _TRAILING.sub(r"\1", _LINE_COMMENT.sub("", t))
        tries += [fixed, fixed.replace("'", '"')]
        tries += sorted(objects_in(fixed.replace("'", '"')), key=len, reverse=True)[:1]
    for t in tries:
        try:
            got = json.loads(t)
        except ValueError:
            continue
        if isinstance(got, dict):
            return json.dumps(got, ensure_ascii=False, sort_keys=True)
    return None


@F.pandas_udf(StringType())
def repair_json(replies: pd.Series) -> pd.Series:
    """Arrow-batched form of repaired(), for the replies that try_parse_json can't read."""
    return replies.map(repaired, na_action="ignore")


def reply_object(c: Column) -> Column:
    """A reply as VARIANT: parsed in the JVM where it is JSON, repaired in Python only where it isn't."""
    direct = F.try_parse_json(c)
    return F.coalesce(direct, F.try_parse_json(F.when(direct.isNull() & c.isNotNull(), repair_json(c))))
