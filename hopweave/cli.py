"""Command line: answer questions or evaluate samples over a node table."""

from __future__ import annotations

import argparse
import logging
import logging.handlers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.config import Settings
from hopweave.functions import parsing
from hopweave.operators import evaluate
from hopweave.plans.providers import generate
from hopweave.plans.retrieval import Engine
from hopweave.session import session
from hopweave.sources import nodes as sources
from hopweave.storage import checkpointed

#: What the judge is asked, and the columns of results that are read back.
JUDGE = "Rate the answer against the reference from 1 to 5. Reply with the number first.\nQuestion: "
RESULT = "uid string, query string, question string, response string, exact_match double, accuracy double, query_type string, source_type string, error string"

log = logging.getLogger("hopweave")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="hopweave")
    p.add_argument("command", choices=("ask", "evaluate"))
    p.add_argument("--nodes", required=True, help="folder of the node table")
    p.add_argument("--dim", type=int, default=64)
    p.add_argument("--question", default="")
    p.add_argument("--samples", default="")
    p.add_argument("--output", default="")
    p.add_argument("--limit", type=int, default=None)
    p.add_argument("--strategy", choices=("local_text", "cross_modal", "hybrid", "auto"), default="local_text")
    p.add_argument("--resume", action="store_true", help="leave out samples that the output has")
    p.add_argument("--gated", action="store_true", help="retrieve only where the model isn't confident")
    p.add_argument("--log", default="", help="log file beside the console")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=[logging.StreamHandler(), *([logging.handlers.RotatingFileHandler(a.log, maxBytes=10_000_000, backupCount=5)] if a.log else [])])
    spark = session()
    table = sources.read_nodes(spark, a.nodes, a.dim)
    rows = table.select(F.xxhash64("id").alias("node_id"), "text", F.col("embedding").alias("vector"), "modality", F.coalesce("file_path", "id").alias("source"))
    engine = Engine(spark, rows, Settings.from_session(spark).updated(gated=a.gated), stored=True)
    if a.command == "ask":
        asked = spark.createDataFrame([(1, a.question, ("", []))], "question_id long, question string, information struct<text:string,images:array<string>>")
        engine.answer(asked, a.strategy).show(truncate=False)
        return
    samples = sources.scan_samples(spark, a.samples, a.limit)
    if a.output and a.resume:
        samples = sources.resume(samples, sources.read_results(spark, a.output, RESULT))
    scored = checkpointed(evaluated(engine, samples, a.strategy), "results")
    if a.output:
        sources.append_jsonl(scored, a.output)
        scored = sources.read_results(spark, a.output, RESULT)
    evaluate.overall(scored).show()
    evaluate.percent_table(evaluate.by_category(scored)).show()


def evaluated(engine: Engine, samples: DataFrame, strategy: str = "local_text") -> DataFrame:
    """Answers to samples with exact match and the accuracy a model judges; a failed row scores 0."""
    asked = samples.select(
        F.col("ord").alias("question_id"), F.coalesce("query", "question").alias("question"),
        F.struct(F.coalesce("context", F.lit("")).alias("text"), F.coalesce("images", F.array().cast("array<string>")).alias("images")).alias("information"),
    )
    truth = evaluate.ground_truth(F.col("reference_answer"), F.col("ground_truth.answer"), F.col("answer"), F.col("target"), F.col("output"))
    known = samples.select(F.col("ord").alias("question_id"), "uid", F.col("query"), F.coalesce(truth, F.lit("")).alias("reference_answer"), F.col("meta_info.query_type").alias("query_type"), F.col("meta_info.source_type").alias("source_type"))
    done = engine.answer(asked, strategy).withColumnRenamed("answer", "response").join(known, "question_id")
    prompt = F.concat(F.lit(JUDGE), F.coalesce("question", F.lit("")), F.lit("\nReference: "), "reference_answer", F.lit("\nAnswer: "), "response")
    told = generate(done.withColumn("prompt", prompt), engine.llm)
    fine = F.col("error").isNull() & F.col("reply_error").isNull()
    return told.withColumn("exact_match", F.when(F.col("error").isNull(), evaluate.exact_match(F.col("response"), F.col("reference_answer"))).otherwise(0.0)).withColumn(
        "accuracy", F.when(fine, parsing.judged_accuracy(F.col("reply"))).otherwise(0.0)
    ).drop("prompt", "reply", "reply_error")


if __name__ == "__main__":
    main()
