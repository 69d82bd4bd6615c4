"""JSON arrays read by many tasks against one parser, whatever the byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hopweave.sources import json_array, nodes


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return "".join(rng.choices('ab"\\{}[],: é\n\t', k=rng.randrange(0, 12)))
    if kind < 5:
        return rng.choice([None, True, 1, -2.5, "}", '"', "\\", '\\"', "\\\\"])
    if kind < 7:
        return {f"k{rng.choice('ab{[,')}{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_are_those_of_a_byte_by_byte_scan():
    rng = random.Random(1)
    step = {"[": 1, "{": 1, "]": -1, "}": -1, ",": 0}
    checked = 0
    for _ in range(3_000):
        data = "".join(rng.choices('a"\\{}[],', k=rng.randrange(0, 30)))
        for state in range(3):
            at, s, valid = [], state, True
            for i, c in enumerate(data):
                if s == json_array.ESCAPED:
                    s = json_array.STRING
                elif s == json_array.STRING:
                    s = {'"': json_array.OUT, "\\": json_array.ESCAPED}.get(c, s)
                elif c == '"':
                    s = json_array.STRING
                elif c == "\\":
                    valid = False  # a backslash outside of strings is no JSON
                elif c in step:
                    at.append((i, step[c]))
            if valid:
                places, change, after = json_array.structure(data.encode(), state)
                assert ([*zip(places.tolist(), change.tolist())], after) == (at, s), (data, state)
                checked += 1
    assert checked > 1_000


def test_elements_of_any_split(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    for turn in range(2):
        plain = [value(rng) for _ in range(30 + turn)]
        several = {"x": 3, "examples": [value(rng) for _ in range(20)], "meta": {"a": [1, 2], "b": {"c": []}}, "empty": [], "corpus": [value(rng) for _ in range(12)], "s": "[1,2]", "t": [[1], {"u": 2}]}
        for name, doc in (("plain", plain), ("several", several)):
            path = tmp_path / f"{turn}-{name}.json"
            path.write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=turn % 2 == 0) + "\n" * (turn % 2), encoding="utf-8")
            found = json_array.scan_array(spark, str(path)).orderBy("field", "ord").collect()
            got = {}
            for r in found:
                got.setdefault(r["field"], []).append((r["ord"], json.loads(r["element"])))
            arrays = {"": plain} if name == "plain" else {k: v for k, v in several.items() if isinstance(v, list)}
            assert got == {k: [*enumerate(v)] for k, v in arrays.items() if v}, (turn, name)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"uid": f"u{i}", "query": "what is {shown}, \"there\"?" * (i % 7), "reference_answer": f"r{i}"} for i in range(30_000)]
    path = tmp_path / "samples.json"
    path.write_text(json.dumps({"examples": rows}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        text = spark.read.format("text").option("lineSep", "}").load(str(path))
        assert text.rdd.getNumPartitions() > 8
        got = nodes.scan_samples(spark, str(path)).select("ord", "uid", "query", "reference_answer").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["ord"], r["uid"], r["query"], r["reference_answer"]) for r in got] == [(i, r["uid"], r["query"], r["reference_answer"]) for i, r in enumerate(rows)]
    assert nodes.scan_samples(spark, str(path), 3).count() == 3


def test_long_elements_and_broken_files(spark, tmp_path, monkeypatch, small_ranges):
    monkeypatch.setattr(json_array, "CHUNK", 50)
    long = ["é}" * 300, {"a": "x" * 700}, [], {}, [[["}"]]]]
    (tmp_path / "long.json").write_text(json.dumps(long, ensure_ascii=False), encoding="utf-8")
    assert [json.loads(r["element"]) for r in json_array.scan_array(spark, str(tmp_path / "long.json")).orderBy("ord").collect()] == long
    for name, body in (("scalar", "17"), ("empty", ""), ("open", '[{"a": 1}, {"b": '), ("wrong", "]]}}[{"), ("object", '{"a": 1}')):
        (tmp_path / f"{name}.json").write_text(body)
        got = [r["element"] for r in json_array.scan_array(spark, str(tmp_path / f"{name}.json")).collect()]
        assert got[:1] == (['{"a": 1}'] if name == "open" else []), name


def test_legacy_corpora(spark, tmp_path):
    doc = {"corpus": [{"id": "1", "text": "a"}], "image_corpus": [{"id": "2", "description": "b", "image_path": "p.png"}], "audio_corpus": [], "other": [1]}
    (tmp_path / "old.json").write_text(json.dumps(doc))
    (tmp_path / "new.json").write_text(json.dumps({"text_corpus": [{"id": "3", "text": "c"}], "corpus": [{"id": "4", "text": "d"}]}))
    got = nodes.scan_legacy(spark, str(tmp_path)).select("modality", "id", "text", "image_path").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("text", "1", "a", None), ("image", "2", "b", "p.png"), ("text", "3", "c", None)]
    assert nodes.scan_legacy(spark, str(tmp_path)).where(F.col("metadata").isNotNull()).count() == 0
