"""Scores of answers and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.text import eval_normalize, eval_normalize_strict

#: Category, the field it looks at, and the key that field must contain.
CATEGORIES = (
    ("Single-hop", "query_type", "single_hop"),
    ("Multi-hop", "query_type", "multi_hop"),
    ("Text", "source_type", "text"),
    ("Table", "source_type", "table"),
    ("Chart", "source_type", "chart"),
    ("Layout", "source_type", "2d_layout"),
)


def exact_match(answer: Column, truth: Column, strict_ws: bool = False) -> Column:
    """1.0 if both normalise to the same tokens."""
    f = eval_normalize_strict if strict_ws else eval_normalize
    return (f(F.coalesce(answer, F.lit(""))) == f(F.coalesce(truth, F.lit("")))).cast("double")


def normal_digest(c: Column) -> Column:
    """Equal for texts that exact_match() finds equal: the SHA-256 of the normal tokens, in which no space can be."""
    return F.sha2(F.array_join(eval_normalize(F.coalesce(c, F.lit(""))), " "), 256)


def ground_truth(reference: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (reference, *others)))


def overall(results: DataFrame) -> DataFrame:
    """Totals and means of rows (response, exact_match, accuracy); rows without scores count only in the totals."""
    n = F.count("*")
    scored = F.count("exact_match")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    good = F.count_if(F.coalesce("response", F.lit("")) != "")
    return results.agg(
        n.alias("total_queries"), good.alias("successful_queries"), F.round(F.when(n > 0, good / n).otherwise(0.0), 6).alias("success_rate"),
        scored.alias("valid_eval_items"), mean("exact_match").alias("exact_match"), mean("accuracy").alias("accuracy"),
    )


def by_category(results: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Mean scores per category; a row counts in every category whose key its type contains, an empty category is 0.

    One pass with conditional aggregates: no join, and no row is repeated.
    """
    kind = {"query_type": F.lower(F.coalesce("query_type", F.lit("single_hop"))), "source_type": F.lower(F.coalesce("source_type", F.lit("text")))}
    cols = []
    for k, (_, field, key) in enumerate(categories):
        hit = F.contains(kind[field], F.lit(key))
        cols += [F.count_if(hit).alias(f"n{k}"), *(F.coalesce(F.avg(F.when(hit, F.coalesce(c, F.lit(0.0)))), F.lit(0.0)).alias(f"{c}{k}") for c in ("accuracy", "exact_match"))]
    one = results.agg(*cols)
    rows = F.array(*(F.struct(F.lit(name).alias("category"), F.col(f"n{k}").alias("n"), F.round(f"accuracy{k}", 6).alias("accuracy"), F.round(f"exact_match{k}", 6).alias("exact_match")) for k, (name, _, _) in enumerate(categories)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def percent_table(scores: DataFrame) -> DataFrame:
    """Scores as percentages with two decimals, in the fixed order of categories."""
    order = F.array_position(F.array(*(F.lit(c[0]) for c in CATEGORIES)), F.col("category"))
    fmt = lambda c: F.format_string("%.2f", F.col(c) * 100)
    return scores.select(order.cast("long").alias("position"), "category", fmt("accuracy").alias("accuracy"), fmt("exact_match").alias("exact_match")).orderBy("position")


def similarity_records(hits: DataFrame, reranked: DataFrame, k: int = 5) -> DataFrame:
    """Per query, its first k hits before and after reranking as arrays of (score, text, source)."""
    entry = F.struct("rank", "score", "text", "source")
    listed = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(s["score"].alias("score"), s["text"].alias("text"), s["source"].alias("source"))).alias(name))
    return listed(hits, "retrieval_results").join(listed(reranked, "reranked_results"), "query_id", "full_outer")
