"""Times the headline queries and prints one JSON line: BENCH_SF_DIR names the tables, BENCH_CPUS the cores.

``document_tasks`` says by how many tasks the documents are read: a table of one row group is one task, so there the
text queries run on one core until their first shuffle, whatever BENCH_CPUS is.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = (
    "vec_topk", "vec_multi_query_avg", "vec_label_knn_vote", "hybrid_union", "lexical_rerank_topk", "txt_clean", "txt_keywords", "txt_features",
    "char_chunks", "ocr_clean_lines", "context_budget", "exact_dedup_first", "jaccard_pairs", "bridge_chain", "topo_levels", "fusion_context",
    "eval_by_category", "resume_anti_join", "x_pricing_summary",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hopweave.plans.catalog import QUERIES

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    tasks = documents.select("text").mapInArrow(lambda b: b, "text string").groupBy(F.spark_partition_id()).count().count()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run compiles; the second counts
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "document_tasks": tasks}))
    spark.stop()


if __name__ == "__main__":
    main()
