"""Decomposition and review of questions: chains, placeholders, dependency graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.text import SPACE, first_of, strip

PLACEHOLDER = r"\[Answer from Q\d+\]"


def tidy_parallel(question: Column, compat: bool = False) -> Column:
    """Delete placeholders of independent questions, leaving one space (none with ``compat``)."""
    gap = "" if compat else " "
    out = F.regexp_replace(question, rf"(?i)[{SPACE}]*based on {PLACEHOLDER}[{SPACE}]*", gap)
    out = F.regexp_replace(out, rf"[{SPACE}]*{PLACEHOLDER}[{SPACE}]*", gap)
    return F.when(F.contains(question, F.lit("[Answer from")), out if compat else F.regexp_replace(strip(out), r" \?\z", "?")).otherwise(question)


def inject(question: Column, previous: Column) -> Column:
    """Refer a chained question to the answer before it, if it has no placeholder yet."""
    mark = F.concat(F.lit(" based on [Answer from "), previous, F.lit("]"))
    asks = F.endswith(strip(question), F.lit("?"))
    return (
        F.when(question.rlike(PLACEHOLDER), question)
        .when(asks, F.concat(F.regexp_replace(strip(question), r"\?\z", ""), mark, F.lit("?")))
        .otherwise(F.concat(question, mark))
    )


def normalise_subquestions(subs: DataFrame) -> DataFrame:
    """Number and link raw sub-questions: rows (question_id, ord, text, question, routing) -> one row per sub-question.

    Blank ones are dropped first, then the rest numbered, so ids and dependencies have no gaps.
    """
    raw = subs.withColumn("q", first_of(F.col("text"), F.col("question"))).where(F.coalesce(strip(F.col("q")), F.lit("")) != "")
    order = Window.partitionBy("question_id").orderBy("ord")
    n = raw.withColumn("pos", F.row_number().over(order))
    bridge = (F.col("routing") == "bridge_processing") & (F.col("pos") > 1)
    previous = F.concat(F.lit("Q"), F.col("pos") - 1)
    text = F.when(bridge, inject(F.col("q"), previous)).when(F.col("routing") == "parallel_processing", tidy_parallel(F.col("q"))).otherwise(F.col("q"))
    return n.select(
        "question_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("Q"), F.col("pos")).alias("id"), F.concat(F.lit("sub_"), F.col("pos")).alias("sub_id"), text.alias("question"),
        F.when(bridge, "Bridging").otherwise("Independent").alias("type"), F.when(bridge, F.array(previous)).otherwise(F.array().cast("array<string>")).alias("depends_on"), "routing",
    )


def direct_subquestion(questions: DataFrame) -> DataFrame:
    """One sub-question that is the question itself."""
    return questions.select("question_id", F.lit(1).cast("long").alias("pos"), F.lit("Q1").alias("id"), F.lit("sub_1").alias("sub_id"), "question", F.lit("Independent").alias("type"), F.array().cast("array<string>").alias("depends_on"), F.lit("no_decomposition").alias("routing"))


def fallback_subquestions(questions: DataFrame) -> DataFrame:
    """The fixed chain of two steps where no decomposition could be read."""
    steps = F.array(F.concat(F.lit("What facts are needed to answer: "), "question"), F.col("question"))
    raw = questions.select("question_id", F.posexplode(steps).alias("ord", "text"), F.lit(None).cast("string").alias("question"), F.lit("bridge_processing").alias("routing"))
    return normalise_subquestions(raw)


def nonblank_or_question(subs: DataFrame, questions: DataFrame) -> DataFrame:
    """Sub-questions with text; a question that has none left becomes its own ``subq_1``."""
    kept = subs.withColumn("q", strip(first_of(F.col("query"), F.col("question")))).where("q <> ''").select("question_id", "sub_id", F.col("q").alias("question"))
    lone = questions.join(kept, "question_id", "left_anti").select("question_id", F.lit("subq_1").alias("sub_id"), "question")
    return kept.unionByName(lone)


def sort_number(id_: Column) -> Column:
    """The first integer in an id, 0 without one: the order of execution."""
    return F.coalesce(F.nullif(F.regexp_extract(id_, r"(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0))


def resolve(question: Column, answers: Column, depends_on: Column) -> Column:
    """Put answers in for ``[Answer from X]``, and for ``from X`` where X is a declared dependency.

    answers: MAP<id, answer> with ids Qn and sub_n as aliases. Unknown ids stay as they are; ids match whole.
    """
    ids = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\[Answer from ([^\]]+)\]"), 1))
    out = F.reduce(
        ids, question,
        lambda q, i: F.coalesce(F.replace(q, F.concat(F.lit("[Answer from "), i, F.lit("]")), F.concat(F.lit('"'), F.try_element_at(answers, i), F.lit('"'))), q),
    )
    word = lambda i: F.concat(F.lit(r"\Q"), i, F.lit(r"\E(?![A-Za-z0-9_])"))
    quoted = lambda i: F.concat(F.lit('"'), F.regexp_replace(F.try_element_at(answers, i), r"([\\$])", r"\\$1"), F.lit('"'))
    return F.reduce(
        depends_on, out,
        lambda q, i: F.coalesce(
            F.regexp_replace(F.regexp_replace(q, F.concat(F.lit("(?i)country identified in "), word(i)), quoted(i)), F.concat(F.lit("(?i)from "), word(i)), F.concat(F.lit("from "), quoted(i))), q,
        ),
    )


def aliases(id_: Column) -> Column:
    """An id under both of its names: Qn and sub_n."""
    return F.array_distinct(F.array(id_, F.regexp_replace(id_, r"^sub_(\d+)\z", "Q$1"), F.regexp_replace(id_, r"^Q(\d+)\z", "sub_$1")))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path level of each node: nodes (graph, id), edges (graph, id, depends_on); level -1 for nodes on or behind a cycle.

    Nodes without open dependencies are peeled off, round by round, inside one row per graph: a graph is one
    question's handful of sub-questions, and all graphs are dealt over the cluster by one shuffle. Dependencies
    on unknown ids are ignored.
    """
    deps = edges.groupBy("graph", "id").agg(F.collect_set("depends_on").alias("deps"))
    full = nodes.distinct().join(deps, ["graph", "id"], "left")
    row = full.groupBy("graph").agg(F.collect_list(F.struct("id", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))).alias("nodes"))
    ids = F.transform("nodes", lambda x: x["id"])
    start = F.array().cast("array<struct<id:string,level:int>>")

    def peel(done, i):
        have = F.transform(done, lambda d: d["id"])
        free = F.filter("nodes", lambda x: ~F.array_contains(have, x["id"]) & F.forall(F.array_intersect(x["deps"], ids), lambda d: F.array_contains(have, d)))
        return F.concat(done, F.transform(free, lambda x: F.struct(x["id"].alias("id"), i.alias("level"))))

    placed = row.select("graph", ids.alias("ids"), F.aggregate(F.sequence(F.lit(0), F.size("nodes") - 1), start, peel).alias("placed"))
    level = lambda i: F.coalesce(F.try_element_at(F.filter("placed", lambda d: d["id"] == i), F.lit(1))["level"], F.lit(-1))
    return placed.select("graph", F.explode(F.transform("ids", lambda i: F.struct(i.alias("id"), level(i).alias("level")))).alias("n")).select("graph", "n.id", "n.level")


def cyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (graph, id) on a cycle or behind one."""
    return levels(nodes, edges).where("level < 0").select("graph", "id")


def review(subs: DataFrame) -> DataFrame:
    """Approve or reject each question's sub-questions: rows (question_id, id, depends_on) -> (question_id, status, reason, n)."""
    nodes = subs.select(F.col("question_id").alias("graph"), "id")
    edges = subs.select(F.col("question_id").alias("graph"), "id", F.explode("depends_on").alias("depends_on"))
    loops = cyclic(nodes, edges).select(F.col("graph").alias("question_id")).distinct().withColumn("loop", F.lit(True))
    n = subs.groupBy("question_id").agg(F.count_if(F.col("id").isNotNull()).alias("n"))
    reason = F.when(F.col("n") == 0, "subquery_count").when(F.col("loop"), "circular_dependency")
    return n.join(loops, "question_id", "left").select("question_id", F.when(reason.isNull(), "approved").otherwise("rejected").alias("status"), reason.alias("reason"), "n")


def accept_after_retries(reviewed: DataFrame) -> DataFrame:
    """A question still rejected keeps its sub-questions only if it has two to five."""
    return reviewed.withColumn("accepted", (F.col("status") == "approved") | F.col("n").between(2, 5))


def restore_placeholder(question: Column, pos: Column, type_: Column, depends_on: Column, original: Column) -> Column:
    """Put a lost reference back in front of a chained question after review."""
    deps = F.when(F.coalesce(F.size(depends_on), F.lit(0)) > 0, depends_on).otherwise(original)
    bridge = type_.isin("Bridge", "Bridging") | (F.coalesce(F.size(deps), F.lit(0)) > 0)
    dep = F.regexp_replace(F.coalesce(F.try_element_at(deps, F.lit(1)), F.concat(F.lit("Q"), pos - 1)), r"^sub_(\d+)\z", "Q$1")
    lost = bridge & (pos > 1) & ~question.rlike(r"\[Answer from [^\]]+\]")
    return F.when(F.coalesce(lost, F.lit(False)), F.concat(F.lit("Based on [Answer from "), dep, F.lit("], "), question)).otherwise(question)
