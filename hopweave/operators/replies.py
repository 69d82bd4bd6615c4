"""What planners, decomposers, reviewers and hits return, read into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions import parsing
from hopweave.functions.text import first_of
from hopweave.operators.planning import restore_placeholder

#: The keys under which a decomposition may list its sub-questions, in the order they are tried.
SUBQUESTION_KEYS = ("sub_questions", "subquestions", "subqueries", "questions", "decomposition_result")


def _int(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string").try_cast("int")


def planned(reply: Column, question: Column, images: Column, confidence: Column, threshold: float = 0.9) -> Column:
    """Score and routing of a question as a struct.

    Complexities come from the planner's reply where it can be read (values out of range count as unread), else
    from the rules; retrieval is needed below the confidence threshold; routing is Direct_Gen only without it.
    """
    v = parsing.reply_object(reply)
    read = lambda name, low, high: F.when(F.coalesce(_int(v, f"$.score.{name}"), _int(v, f"$.{name}")).between(low, high), F.coalesce(_int(v, f"$.score.{name}"), _int(v, f"$.{name}")))
    need = F.when(parsing.needs_retrieval(confidence, threshold), 1).otherwise(0)
    return F.struct(
        F.coalesce(read("modality_complexity", 1, 3), parsing.modality_complexity(images)).alias("modality_complexity"),
        F.coalesce(read("multi_hop_complexity", 1, 5), parsing.parallel_hops(question)).alias("multi_hop_complexity"),
        need.alias("retrieval_necessity"),
        F.when(need == 0, "Direct_Gen").otherwise("Multi_Agent").alias("routing_decision"),
    )


def decomposed(replies: DataFrame) -> DataFrame:
    """Raw sub-questions of (question_id, reply, routing): the first non-empty list among the known keys, one row per item."""
    v = parsing.reply_object(F.col("reply"))
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in SUBQUESTION_KEYS]
    items = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    rows = replies.select("question_id", "routing", F.posexplode(items).alias("ord", "n"))
    get = lambda p: F.try_variant_get("n", p, "string")
    plain = F.when(F.schema_of_variant("n") == "STRING", F.try_variant_get("n", "$", "string"))
    return rows.select("question_id", "ord", first_of(get("$.text"), plain).alias("text"), get("$.question").alias("question"), "routing")


def refined(original: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sub-questions after review, joined by position: original (question_id, pos, question, type, depends_on), reviews (question_id, reply).

    A question whose review can't be read or lists nothing keeps its original sub-questions; the reviewer may
    change their number. Lost references are restored.
    """
    v = parsing.reply_object(F.col("reply"))
    items = F.try_variant_get(v, "$.refined_subqueries", "array<variant>")
    told = reviews.select("question_id", F.posexplode(items).alias("at", "n")).withColumn("pos", F.col("at").cast("long") + 1)
    get = lambda p, t="string": F.try_variant_get("n", p, t)
    old = original.select("question_id", "pos", F.col("question").alias("old"), F.col("type").alias("old_type"), F.col("depends_on").alias("old_deps"))
    new = told.join(old, ["question_id", "pos"], "left").select(
        "question_id", "pos", first_of(get("$.question"), F.col("old")).alias("question"), F.coalesce(get("$.type"), "old_type").alias("type"), F.coalesce(get("$.dependencies", "array<string>"), F.array().cast("array<string>")).alias("deps"), "old_deps"
    )
    new = new.withColumn("question", restore_placeholder(F.col("question"), F.col("pos"), F.coalesce("type", F.lit("")), F.col("deps"), F.col("old_deps")))
    new = new.select("question_id", "pos", "question", F.coalesce("type", F.lit("Independent")).alias("type"), F.when(F.size("deps") > 0, F.col("deps")).otherwise(F.coalesce("old_deps", "deps")).alias("depends_on"))
    kept = original.join(new.select("question_id").distinct(), "question_id", "left_anti")
    return new.unionByName(kept.select("question_id", "pos", "question", "type", "depends_on"))


def without_vectors(metadata: Column) -> Column:
    """Metadata (a VARIANT object) as a map without its vector and embedding."""
    return F.map_filter(F.try_variant_get(metadata, "$", "map<string,variant>"), lambda k, v: ~k.isin("vector", "embedding"))


def hit_source(metadata: Column, source: Column) -> Column:
    """Where a hit is from: file name, id, then its source; ``unknown`` without any."""
    get = lambda p: F.try_variant_get(metadata, p, "string")
    return first_of(get("$.file_name"), get("$.filename"), get("$.id"), source, F.lit("unknown"))


def hit_text(text: Column, metadata: Column, source: Column) -> Column:
    """What a hit shows: its text, that of its metadata, content, description, else its source."""
    get = lambda p: F.try_variant_get(metadata, p, "string")
    return first_of(text, get("$.text"), get("$.content"), get("$.description"), F.concat(F.lit("Source: "), source))
