"""Fusion of sub-results: union of context, rendering, answer fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.parsing import clean_answer
from hopweave.functions.text import first_of, is_vector_text, strip

NO_RESULTS = "No valid sub-question answers were found."


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits with a text that is no printed vector."""
    return hits.where("text is not null and text <> ''").where(~is_vector_text(F.col("text")))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One hit per (question, text): the first by sub-question and rank. Partial aggregation, no window."""
    others = [c for c in hits.columns if c not in ("question_id", "text")]
    first = hits.groupBy("question_id", "text").agg(F.min_by(F.struct(*others), F.struct("sub_ord", "rank")).alias("h"))
    return first.select("question_id", "text", "h.*")


def distinct_images(images: Column) -> Column:
    """Union of arrays of image paths, first seen first."""
    return F.array_distinct(F.flatten(images))


def data_image(images: Column) -> Column:
    """The first image that is a data URI."""
    return F.try_element_at(F.filter(images, lambda i: F.startswith(i, F.lit("data:image/"))), F.lit(1))


def joined_texts(df: DataFrame) -> DataFrame:
    """The information texts of a question's sub-results, in order, joined by a space and trimmed."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sub_ord", F.coalesce("information", F.lit("")).alias("t")))), lambda s: s["t"])
    return df.groupBy("question_id").agg(strip(F.array_join(parts, " ")).alias("information"))


def sources(n: Column) -> Column:
    """Q1 to Qn."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("Q"), i))).otherwise(F.array().cast("array<string>"))


def context_lines(hits: DataFrame) -> DataFrame:
    """Each usable hit with its id Q{i}_R{j}: i the sub-question's position, j the hit's among the usable ones."""
    order = Window.partitionBy("question_id", "sub_ord").orderBy("rank")
    n = usable_hits(hits).withColumn("j", F.row_number().over(order))
    label = F.concat(F.lit("Q"), F.col("sub_ord"), F.lit("_R"), F.col("j"))
    line = F.format_string("[%s] (score %.2f) %s", label, F.col("score"), F.col("text"))
    if "source" in hits.columns:
        line = F.concat(line, F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" | source: "), "source")).otherwise(""))
    return n.select("question_id", "sub_ord", "j", label.alias("source_id"), line.alias("line"))


def context(hits: DataFrame) -> DataFrame:
    """The rendered context of each question: one line per hit, by sub-question and rank."""
    ordered = F.array_sort(F.collect_list(F.struct("sub_ord", "j", "line")))
    return context_lines(hits).groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("context"), F.count("*").alias("n_hits"))


def prompt(question: Column, rendered: Column) -> Column:
    """The prompt: with the context, or for general knowledge where there is none."""
    return F.when(F.coalesce(rendered, F.lit("")) == "", F.concat(F.lit("Answer briefly from general knowledge.\nQuestion: "), question)).otherwise(
        F.concat(F.lit("Answer briefly from the context.\nContext:\n"), rendered, F.lit("\nQuestion: "), question)
    )


def valid_subresults(subs: DataFrame, questions: DataFrame) -> DataFrame:
    """Sub-results without an error; a question that has none left gets one placeholder row."""
    good = subs.where("error is null").select("question_id", "sub_ord", "answer")
    lone = questions.join(good, "question_id", "left_anti").select("question_id", F.lit(1).cast("long").alias("sub_ord"), F.lit(NO_RESULTS).alias("answer"))
    return good.select("question_id", F.col("sub_ord").cast("long").alias("sub_ord"), "answer").unionByName(lone)


def final_answer(model: Column, sub_answers: Column, knowledge: Column) -> Column:
    """The model's text, else the sub-answers joined, else the knowledge reply; cleaned. A bare JSON scalar stays text."""
    return clean_answer(first_of(model, F.array_join(F.filter(sub_answers, lambda a: F.coalesce(a, F.lit("")) != ""), " "), knowledge, F.lit("")))


def legacy(answers: DataFrame) -> DataFrame:
    """A map of id to answer as rows of sub-results, in order of their numbers."""
    rows = answers.select("question_id", F.explode("answers").alias("id", "answer"))
    return rows.select("question_id", "id", F.concat(F.lit("Sub-question "), "id").alias("question"), "answer")


def error_record(message: Column) -> Column:
    return F.concat(F.lit("Error occurred: "), message)
