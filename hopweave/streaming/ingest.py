"""Incremental ingestion as a stream that stops when all new files are read.

What a stream has taken it remembers by key in its state, across batches, runs and restarts, for ever or until a key
is older than ``expiry``. Time is that of a key's arrival (its batch's), so no row is ever too late and none is dropped but
repetitions. Keys for ever want a state store that spills (``spark.sql.streaming.stateStore.providerClass`` of RocksDB);
the state's partitions are the session's shuffle partitions at the first run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.providers import ModelSpec, embed
from hopweave.sources.nodes import load_texts, stem


def _run(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to: a new checkpoint is another stream, and gets folders of its own."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def unseen(rows: DataFrame, key: str, expiry: str | None = None) -> DataFrame:
    """Of a stream the first row of each key; with an expiry, a key counts as new again that long after it was taken."""
    if expiry is None:
        return rows.dropDuplicates([key])
    columns = rows.columns
    return rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", expiry).dropDuplicatesWithinWatermark([key]).select(columns)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, spec: ModelSpec | None = None, expiry: str | None = None) -> None:
    """Embed the JSON texts that arrived since the last run and append them to the node table; a name (without its suffix) is taken once.

    The checkpoint remembers files and names, so a file is read once even if a run dies in between.
    """
    spec = spec or ModelSpec()
    files = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(source).schema).option("pathGlobFilter", "*.json").load(source)
    new = unseen(files.select("path", "content", stem(F.col("path")).alias("id")), "id", expiry)

    def write(batch: DataFrame, batch_id: int) -> None:
        nodes = load_texts(batch).select(stem(F.col("path")).alias("id"), "text", F.col("path").alias("file_path"), F.lit("text").alias("modality"))
        nodes = nodes.withColumn("embedding", embed(F.col("text"), spec)).where("embedding is not null")
        nodes.write.mode("overwrite").parquet(f"{target}/run={_run(spark, checkpoint)}/batch={batch_id}")

    new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_rows(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, expiry: str | None = None, files_per_batch: int | None = None) -> None:
    """Parquet rows that arrived since the last run, appended to the target: each key once, whatever batches, runs and restarts it comes in.

    A batch that is done again overwrites its own folder, so each row is there once.
    """
    read = spark.readStream.schema(schema)
    rows = unseen((read.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else read).parquet(source), key, expiry)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/run={_run(spark, checkpoint)}/batch={batch_id}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
