"""The versioned store against a dictionary, with readers and writers at the same time; streams that take a key once."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from hopweave.sources.store import VectorStore
from hopweave.streaming.ingest import append_rows, ingest


def vectors(spark, ids, mark=0):
    return spark.createDataFrame([(f"n{i}", mark, [1.0, float(i), float(mark)]) for i in ids], "id string, mark int, embedding array<float>")


def ids(df):
    return sorted((r["id"], r["mark"]) for r in df.select("id", "mark").collect())


def test_versions_snapshots_and_compaction(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "s"), 3)
    assert s.versions() == [0] and s.read().count() == 0
    assert s.add(vectors(spark, range(6))) == 1
    first = s.read()
    assert s.add(vectors(spark, range(6, 9))) == 2
    assert s.delete(spark.createDataFrame([("n1",), ("n7",), ("gone",)], "id string")) == 3
    assert s.add(vectors(spark, [1], 5)) == 4  # back again, as another vector
    want = [("n0", 0), ("n1", 5), ("n2", 0), ("n3", 0), ("n4", 0), ("n5", 0), ("n6", 0), ("n8", 0)]
    assert ids(s.read()) == want
    assert s.compact() == 5 and ids(s.read()) == want and len(s.manifest()["data"]) == 1 and not s.manifest()["tombstones"]
    reader = s.read()
    assert s.clear() == 6 and s.read().count() == 0
    s.add(vectors(spark, [2], 9))
    assert ids(reader) == want and ids(first) == [(f"n{i}", 0) for i in range(6)]  # whoever has a version keeps it
    assert ids(s.read(2)) == [(f"n{i}", 0) for i in range(9)] and ids(s.read(7)) == [("n2", 9)]
    norms = s.read(5).select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in norms)
    # One wrong dimension rejects a batch whole; nothing to add is no version.
    assert s.add(vectors(spark, [1]).withColumn("embedding", F.array(F.lit(1.0).cast("float")))) == 7 and s.add(vectors(spark, [1]).limit(0)) == 7
    assert s.vacuum(keep=1) > 0 and s.versions() == [0, 7] and ids(s.read()) == [("n2", 9)]


def test_what_comes_during_a_compaction_stays(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "s"), 3)
    for k in range(3):
        s.add(vectors(spark, range(4 * k, 4 * k + 4)))
    plain = s._publish

    def late(change):
        s._publish = plain
        s.add(vectors(spark, [50]))
        s.delete(spark.createDataFrame([("n0",), ("n50",)], "id string"))
        s.add(vectors(spark, [50], 1))
        return plain(change)

    s._publish = late
    s.compact()
    assert ids(s.read()) == sorted([(f"n{i}", 0) for i in range(1, 12)] + [("n50", 1)])
    s._publish = lambda change: (setattr(s, "_publish", plain), plain(lambda m: m | {"data": [], "tombstones": []}), plain(change))[-1]
    s.compact()
    assert s.read().count() == 0  # cleared meanwhile


def test_writers_at_the_same_time_all_count(spark, tmp_path):
    path = str(tmp_path / "s")
    batches = [vectors(spark, [k]) for k in range(6)]
    done = []

    def work(k):
        done.append(VectorStore(spark, path, 3).add(batches[k]))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == [1, 2, 3, 4, 5, 6] and VectorStore(spark, path, 3).read().count() == 6


def rows(spark, ids, mark):
    return spark.createDataFrame([(i, mark) for i in ids], "k long, mark long").repartition(2)


def taken(spark, target):
    return sorted((r["k"], r["mark"]) for r in spark.read.parquet(target).collect())


def test_a_key_is_taken_once_across_batches_and_restarts(spark, tmp_path):
    source, target, check = (str(tmp_path / p) for p in ("s", "t", "c"))
    run = lambda: append_rows(spark, source, "k long, mark long", target, check, "k", files_per_batch=1)
    rows(spark, [1, 2, 2, 3], 0).write.mode("append").parquet(source)
    run()
    rows(spark, [3, 4], 1).write.mode("append").parquet(source)
    run()
    rows(spark, [1, 5, 5], 2).write.mode("append").parquet(source)
    run()
    run()
    assert taken(spark, target) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2)]


def test_keys_expire(spark, tmp_path):
    source, target, check = (str(tmp_path / p) for p in ("s", "t", "c"))
    for turn in range(4):
        rows(spark, [1], turn).write.mode("append").parquet(source)
        append_rows(spark, source, "k long, mark long", target, check, "k", expiry="1 second")
        time.sleep(1.2)
    found = [m for _, m in taken(spark, target)]
    assert found[0] == 0 and 1 < len(found) < 4


def test_a_name_is_ingested_once(spark, tmp_path):
    source, target, check = tmp_path / "s", str(tmp_path / "t"), str(tmp_path / "c")
    source.mkdir()
    for turn, name in enumerate(("a", "b", "a")):
        folder = source
        (folder / f"{name}.json").write_text(json.dumps({"text": f"turn {turn}"}))
        ingest(spark, str(source), target, check)
    got = spark.read.parquet(target).select("id", "text").collect()
    assert sorted((r["id"], r["text"]) for r in got) == [("a", "turn 0"), ("b", "turn 1")]


@pytest.mark.parametrize("bad", ["", None])
def test_blank_texts_are_no_nodes(spark, tmp_path, bad):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text(json.dumps({"text": bad}))
    (tmp_path / "s" / "y.json").write_text(json.dumps({"text": "words"}))
    ingest(spark, str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["y"]
