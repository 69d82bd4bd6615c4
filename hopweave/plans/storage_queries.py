"""Queries of what is stored, streamed and asked: node files, versions, keyed streams, logged replies, pruned search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.operators import pruned
from hopweave.plans import calls
from hopweave.plans.providers import ModelSpec, generate
from hopweave.plans.text_queries import read
from hopweave.plans.vector_queries import ORACLES as _VECTOR_SQL
from hopweave.plans.vector_queries import _sides
from hopweave.sources.node_source import NodeDataSource
from hopweave.sources.store import VectorStore
from hopweave.storage import fresh
from hopweave.streaming.ingest import append_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return wrap


@query("select vec_id::varchar as id, label::varchar as text, case when label % 2 = 0 then 'text' else 'image' end as modality, len(embedding)::int as dim, round(embedding[1]::double, 6) as first from embeddings")
def node_source_stream(spark, sf_dir):
    """Vectors written as node files in two commits, streamed on into other node files, and read back from these."""
    spark.dataSource.register(NodeDataSource)
    source, target = fresh(spark, "nodes"), fresh(spark, "streamed")
    null = F.lit(None).cast("string")
    e = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("text"), F.when(F.col("label") % 2 == 0, "text").otherwise("image").alias("modality"),
        null.alias("image_path"), null.alias("file_path"), null.alias("metadata"), F.col("embedding").cast("array<float>").alias("embedding"),
    )
    for modality in ("text", "image"):
        e.where(F.col("modality") == modality).write.format("node").mode("append").save(source)
        stream = spark.readStream.format("node").load(source).writeStream.format("node").option("path", target).option("checkpointLocation", f"{target}-checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("node").load(target).select("id", "text", "modality", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(
    """with v(version) as (select unnest(range(1, 7))::bigint), e as (select vec_id, label from embeddings where len(embedding) = 64),
    s as (select version, vec_id, label from v, e where (version <= 4 and vec_id % 2 = 0) or (version between 2 and 4 and vec_id % 2 = 1) or (version = 6 and vec_id % 5 = 0))
    select version, count(*) as n, sum(vec_id)::bigint as ids, sum(label)::bigint as labels from (
      select version, vec_id, label from s where version in (1, 2, 6) or vec_id % 3 <> 0
      union all select version, vec_id, -1 from s where version = 4 and vec_id % 6 = 0
    ) group by version order by version"""
)
def store_versions(spark, sf_dir):
    """What each version of a store held: even ids, all, all but every third, some of these again under another label, none, every fifth; read after a compaction."""
    e = read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("id"), "label", "embedding")
    store = VectorStore(spark, fresh(spark, "store"), 64)
    store.add(e.where("id % 2 = 0"))
    store.add(e.where("id % 2 = 1"))
    store.delete(e.where("id % 3 = 0"))
    store.add(e.where("id % 6 = 0").withColumn("label", F.lit(-1).cast(e.schema["label"].dataType)))
    store.clear()
    store.add(e.where("id % 5 = 0"))
    store.delete(e.where("id < 0"))
    store.compact()
    out = None
    for version in range(1, 7):
        rows = store.read(version if version < 6 else None).select(F.lit(version).cast("long").alias("version"), "id", "label")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("version").agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("ids"), F.sum("label").cast("long").alias("labels"))


@query("select click_id, count(*) as seen, 1::bigint as taken from (select click_id from clicks union all select click_id from clicks where click_id % 7 = 0) where click_id is not null group by click_id")
def stream_keys(spark, sf_dir):
    """Clicks that repeat within and across three arrivals, taken by a stream that is started anew for each: every key once."""
    source, target = fresh(spark, "clicks"), fresh(spark, "taken")
    clicks = read(spark, sf_dir, "clicks").select("click_id", "kind").where("click_id is not null")
    arrivals = (clicks.where("click_id % 2 = 0"), clicks.where("click_id % 2 = 1"), clicks.where("click_id % 7 = 0"))
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        append_rows(spark, source, T.StructType(clicks.schema.fields), target, f"{target}-checkpoint", "click_id", files_per_batch=64)
    seen = spark.read.schema(clicks.schema).parquet(source).groupBy("click_id").agg(F.count("*").alias("seen"))
    return seen.join(spark.read.parquet(target).groupBy("click_id").agg(F.count("*").alias("taken")), "click_id")


@query("select doc_id, 'stub answer to about ' || source || ' in ' || lang as reply, true as logged from documents where source is not null and lang is not null")
def model_calls(spark, sf_dir):
    """Replies to a prompt per document, asked several at a time and written down; a second run of that name finds them all in the log."""
    spec, folder = ModelSpec(concurrency=4), fresh(spark, "replies")
    prompts = read(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", F.concat(F.lit("Say: about "), "source", F.lit(" in "), "lang").alias("prompt"))
    generate(prompts, spec, log=(folder, "one")).write.format("noop").mode("overwrite").save()
    told = generate(prompts.withColumn("key", calls.keyed(F.col("prompt"), spec)), spec, log=(folder, "one"))
    known = calls.replies(spark, folder, "one").withColumnRenamed("reply", "known")
    return told.join(known, "key", "left").select("doc_id", "reply", F.coalesce(F.col("known") == F.col("reply"), F.lit(False)).alias("logged"))


@query(_VECTOR_SQL["vec_topk"])
def vec_topk_pruned(spark, sf_dir):
    """The hits of vec_topk from a clustered layout, of which only pieces are read that can hold one."""
    queries, corpus = _sides(spark, sf_dir)
    path = fresh(spark, "clustered")
    pruned.write_clustered(corpus, path, 64)
    return pruned.search(spark, queries, path, 10).hits.withColumn("rank", F.col("rank").cast("long"))
