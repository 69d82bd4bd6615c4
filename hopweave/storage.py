"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder made for a local session that names none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session that names none (a test) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        app = spark.sparkContext.applicationId
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="hopweave-")
        found = _local[app]
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/hopweave-{name}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "levels") -> DataFrame:
    """The rows as a table of their own: read again they are not computed again, and a lost executor costs a re-read."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that go to Python at once, where the session doesn't set its own number: texts can be long.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Have the session hand Python BATCH_ROWS rows at once, unless it has been told a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, BATCH_ROWS)
