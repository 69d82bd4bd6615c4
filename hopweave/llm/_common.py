"""What the operators of this subpackage share: tables in the shared folder, folds, components.

Every intermediate result that is read twice is written as Parquet under the folder named by
``spark.checkpoint.dir`` (a folder all executors see), so a lost executor costs a re-read, not a
recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


#: The folder made for a local session that names none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``, or a temporary one where a local session has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="hopweave-")
        _local[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: Rows that go to Python at once, where the session doesn't set its own number: texts can be long.
BATCH_ROWS = 500


def released() -> None:
    """Give memory that is free back to the system, at the end of a task: a worker lives on beside the next stage's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what it likes
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Have the session hand Python BATCH_ROWS rows at once, unless it has been told a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, BATCH_ROWS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/hopweave/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._hopweave_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_hopweave_path", None):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, modulus: int):
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reached.

    Alternating large-star and small-star contraction: each round is two partial-aggregated minima
    and two joins, so a hub with very many neighbours is never gathered in one place. Links stay in
    tables; only the number of remaining changes reaches the driver. Nodes without edges are absent.
    """
    spark = edges.sparkSession
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        nxt = stored(small, "edges")
        # A fixpoint is a forest of stars: no node is both a child and a parent, no child has two parents.
        state = nxt.groupBy("u").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
        nested = 1 if state > 1 else nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        dropped(now)
        now = nxt
        if state <= 1 and not nested:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def ranked(rows: DataFrame, group: list[str], key: list[str], name: str, per_block: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gathering a group: blocks by hash, then block offsets.

    ``rows`` should be a stored table: it is read twice. Ties in ``key`` are numbered in any order.
    """
    blocks = max(1, -(-rows.count() // per_block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    offsets = sizes.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*key)))
    return within.join(offsets, [*group, "_block"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_block", "_row", "_before")


def cumulated(rows: DataFrame, size: str, key: list[str], name: str, per_block: int = 20_000) -> DataFrame:
    """The sum of ``size`` before each row, in one fixed order of the whole (stored) table, by blocks."""
    blocks = max(1, -(-rows.count() // per_block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))
    all_before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_block").agg(F.sum(size).alias("_n"))
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_sum", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return within.join(offsets, "_block").withColumn(name, F.col("_before") + F.col("_sum")).drop("_block", "_sum", "_before")
