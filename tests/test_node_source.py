"""The node data source: commits in two phases, batch and stream, foreign folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hopweave.sources import node_source
from hopweave.sources.node_source import NodeDataSource


@pytest.fixture
def nodes(spark):
    spark.dataSource.register(NodeDataSource)
    rows = spark.range(300).select(
        F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("text \"é\n"), "id").alias("text"), F.lit("text").alias("modality"), F.lit(None).cast("string").alias("image_path"), F.lit("f.json").alias("file_path"),
        F.lit('{"a": 1}').alias("metadata"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"),
    )
    return rows.repartition(3)


def shown(df):
    return sorted(tuple(r) for r in df.collect())


def test_written_and_read_back(spark, nodes, tmp_path):
    path = str(tmp_path / "n")
    nodes.write.format("node").mode("append").option("maxFileBytes", "4000").save(path)
    back = spark.read.format("node").load(path)
    assert shown(back) == shown(nodes)
    files = [f for f in os.listdir(path) if f.endswith(".node")]
    assert len(files) > 6 and all(isinstance(json.load(open(f"{path}/{f}")), list) for f in files)
    assert spark.read.format("node").option("maxPartitionBytes", "9000").load(path).rdd.getNumPartitions() > 3
    nodes.write.format("node").mode("append").save(path)
    assert spark.read.format("node").load(path).count() == 600
    nodes.limit(5).write.format("node").mode("overwrite").save(path)
    assert spark.read.format("node").load(path).count() == 5
    assert spark.read.format("node").load(str(tmp_path / "absent")).count() == 0


def test_a_failed_job_leaves_nothing_to_read(spark, nodes, tmp_path):
    path = str(tmp_path / "n")
    nodes.limit(20).write.format("node").mode("append").save(path)

    def die(batches):
        for k, pdf in enumerate(batches):
            if "n299" in set(pdf["id"]):
                raise ValueError("lost")
            yield pdf

    with pytest.raises(Exception, match="lost"):
        nodes.mapInPandas(die, nodes.schema).write.format("node").mode("append").save(path)
    assert spark.read.format("node").load(path).count() == 20
    assert len(os.listdir(f"{path}/_commits")) == 1
    # A file that a dead task left behind is named by no commit.
    (tmp_path / "n" / "part-dead.node").write_text('[\n{"id": "x", "text": "y"}\n]\n')
    assert spark.read.format("node").load(path).count() == 20


def test_stream_reads_and_writes_each_commit_once(spark, nodes, tmp_path):
    source, target, check = (str(tmp_path / p) for p in ("s", "t", "c"))

    def run(at=check):
        q = spark.readStream.format("node").load(source).writeStream.format("node").option("checkpointLocation", at).option("path", target).option("stream", "one").trigger(availableNow=True).start()
        q.awaitTermination()

    nodes.limit(50).write.format("node").mode("append").save(source)
    run()
    nodes.where("id in ('n1', 'n2', 'n3')").write.format("node").mode("append").save(source)
    run()
    run()
    back = spark.read.format("node").load(target)
    assert back.count() == 53
    # A batch that is written again, as after a crash between commit and checkpoint, is one batch.
    folder = node_source._Folder(target)
    tag = folder.commits()[-1]["tag"]
    assert not folder.publish([("part-again.node", 1)], False, tag) and spark.read.format("node").load(target).count() == 53


def test_foreign_folders(spark, nodes, tmp_path):
    (tmp_path / "a.node").write_text(json.dumps([{"text": "one", "embedding": [[1, 2], [3]]}, 7, {"content": "two", "metadata": {"id": "m", "file_path": "f"}}]))
    (tmp_path / "b.node").write_text(json.dumps({"id": 5, "image_path": "i.png", "vector": [1.5]}))
    (tmp_path / "c.node").write_text("{broken")
    (tmp_path / "d.node").write_text(json.dumps({"id": "d", "embedding": ["x"]}))
    (tmp_path / "e.json").write_text("[]")
    got = {r["id"]: r for r in spark.read.format("node").load(str(tmp_path)).collect()}
    assert set(got) == {"a", "m", "5", "d"}
    assert got["a"]["embedding"] == [1.0, 2.0, 3.0] and got["m"]["text"] == "two" and got["m"]["file_path"] == "f"
    assert got["5"]["modality"] == "image" and got["5"]["embedding"] == [1.5] and got["d"]["embedding"] is None
    nodes.limit(3).write.format("node").mode("append").save(str(tmp_path))
    assert spark.read.format("node").load(str(tmp_path)).count() == 7
    with pytest.raises(Exception):
        spark.read.format("node").option("mode", "FAILFAST").load(str(tmp_path)).count()
