"""The text functions as SQL functions: bodies are expressions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hopweave.functions.text import SPACE, token_pattern

#: name -> (parameters, result type, body). Bodies stay in the JVM.
SQL_FUNCTIONS = {
    "hw_collapse": ("s string", "string", f"regexp_replace(s, r'[{SPACE}]+', ' ')"),
    "hw_words": ("s string", "array<string>", f"filter(split(s, r'[{SPACE}]+'), w -> w <> '')"),
    "hw_tokens": ("s string", "array<string>", r"regexp_extract_all(s, '[a-zA-Z0-9]+', 0)"),
    "hw_content_tokens": ("s string", "array<string>", f"regexp_extract_all(s, r'{token_pattern()}', 0)"),
    "hw_strip": ("s string", "string", f"regexp_replace(s, r'^[{SPACE}]+|[{SPACE}]+\\z', '')"),
    "hw_sentences": ("s string", "array<string>", f"filter(transform(split(s, '[.!?;]'), x -> regexp_replace(x, r'^[{SPACE}]+|[{SPACE}]+\\z', '')), x -> x <> '')"),
    "hw_norm": ("a array<double>", "double", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "hw_valid_query": ("s string", "boolean", f"coalesce(length(regexp_replace(s, r'^[{SPACE}]+|[{SPACE}]+\\z', '')) >= 2, false)"),
    "hw_sort_number": ("s string", "bigint", r"coalesce(try_cast(nullif(regexp_extract(s, r'(\d+)', 1), '') as bigint), 0)"),
    "hw_strip_html": ("s string", "string", r"regexp_replace(s, '<[^\\n]*?>', '')"),
    "hw_jaccard": (
        "a string, b string", "double",
        "case when size(array_union(hw_words(lower(a)), hw_words(lower(b)))) = 0 then 0D else size(array_intersect(hw_words(lower(a)), hw_words(lower(b)))) / size(array_union(hw_words(lower(a)), hw_words(lower(b)))) end",
    ),
    "hw_dot": ("a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "hw_route": ("n int", "string", "case when n = 1 then 'no_decomposition' when n in (2, 4) then 'parallel_processing' else 'bridge_processing' end"),
}


def register_all(spark: SparkSession) -> None:
    """Create all of them as temporary SQL functions of the session."""
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns {result} return {body}")
