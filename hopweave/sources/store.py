"""A versioned vector store: immutable Parquet folders, tombstones, and a manifest per version.

    store = VectorStore(spark, path, dim=64)
    store.add(nodes); store.delete(ids); store.clear(); store.compact()
    store.read()            # the newest version
    store.read(version=3)   # what it was then

A manifest names the folders of vectors and of deleted ids that make a version, each with the version that brought it
in; a deletion holds for vectors of earlier versions only, so an id that is added again is back. Data is written first, then the next
manifest is written aside and renamed to its number, which one writer alone can have: another that wants the same number looks
at what has come meanwhile and takes the next. Readers hold a manifest and so keep their version whatever goes on.

Compaction rewrites the vectors of a version without the deleted ones; what has been added or deleted meanwhile stays, and
a store that has been cleared meanwhile is left alone. ``vacuum`` deletes what the newest versions don't name, so a
version lasts as long as it is asked to be kept.

Vectors of another dimension reject a batch whole; those off the unit length have the batch normalised, as in memory.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hopweave.operators.vector import norm, normalize_corpus

#: How often a writer takes the next number after others took the one it wanted.
ATTEMPTS = 50


class VectorStore:
    """See the module. ``key`` names a vector, ``column`` holds it."""

    def __init__(self, spark: SparkSession, path: str, dim: int, key: str = "id", column: str = "embedding"):
        self.spark, self.root, self.dim, self.key, self.column = spark, path.rstrip("/"), dim, key, column
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    # Manifests

    def versions(self) -> list[int]:
        """Every version there is a manifest of, in order; 0 is the empty store."""
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [0, *sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))]

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        if version == 0:
            return {"version": 0, "dim": self.dim, "schema": None, "data": [], "tombstones": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _taken(self, manifest: dict) -> bool:
        """Publish a manifest under its number; False if another writer has it."""
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(aside, self._path(f"{self.root}/manifests/v{manifest['version']:012d}.json"), options)
            return True
        except Exception as e:  # noqa: BLE001 - py4j wraps whatever the file system says
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(aside, False)
            return False

    def _publish(self, change) -> int:
        """Apply a change of manifests to the newest one, again on those that others publish meanwhile; None leaves all as it is."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            new = change(json.loads(json.dumps(now)))
            if new is None:
                return now["version"]
            new["version"] = now["version"] + 1
            if self._taken(new):
                return new["version"]
        raise RuntimeError(f"{ATTEMPTS} versions were taken by other writers")

    # Changes

    def add(self, vectors: DataFrame) -> int:
        """A new version with these vectors too; the version as it is if one of them has another dimension."""
        state = vectors.agg(F.count_if(F.coalesce(F.size(self.column), F.lit(-1)) != self.dim).alias("bad"), F.count_if(F.abs(norm(F.col(self.column)) - 1) > 1e-4).alias("off"), F.count("*").alias("n")).first()
        if state["bad"] or not state["n"]:
            return self.versions()[-1]
        if state["off"]:
            vectors = vectors.withColumn(self.column, normalize_corpus(F.col(self.column)).cast(vectors.schema[self.column].dataType))
        folder = uuid.uuid4().hex
        vectors.write.parquet(f"{self.root}/data/{folder}")

        def change(m: dict) -> dict:
            m["schema"] = m["schema"] or vectors.schema.jsonValue()
            m["data"].append({"folder": folder, "seq": m["version"] + 1})
            return m

        return self._publish(change)

    def delete(self, ids: DataFrame) -> int:
        """A new version without the vectors of these keys (column ``key``)."""
        folder = uuid.uuid4().hex
        ids.select(self.key).distinct().write.parquet(f"{self.root}/tombstones/{folder}")

        def change(m: dict) -> dict:
            m["tombstones"].append({"folder": folder, "seq": m["version"] + 1})
            return m

        return self._publish(change)

    def clear(self) -> int:
        """A new version without any vector; earlier ones stay."""
        return self._publish(lambda m: m | {"data": [], "tombstones": []})

    def compact(self) -> int:
        """A new version of the same vectors in one folder, without what is deleted."""
        base = self.manifest()
        if len(base["data"]) < 2 and not base["tombstones"]:
            return base["version"]
        folder = uuid.uuid4().hex
        self._rows(base).write.parquet(f"{self.root}/data/{folder}")
        merged = [d["folder"] for d in base["data"]]

        def change(m: dict) -> dict | None:
            if not set(merged) <= {d["folder"] for d in m["data"]}:
                return None
            m["data"] = [{"folder": folder, "seq": base["version"]}] + [d for d in m["data"] if d["folder"] not in merged]
            m["tombstones"] = [t for t in m["tombstones"] if t["seq"] > base["version"]]
            return m

        return self._publish(change)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all manifests but the newest ``keep`` and every folder that these don't name; the number of folders deleted.

        Not while others write: a folder that is written but not yet published is named by nobody.
        """
        versions = [v for v in self.versions() if v]
        named = {e["folder"] for v in versions[-keep:] for m in [self.manifest(v)] for e in m["data"] + m["tombstones"]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}.json"), False)
        gone = 0
        for kind in ("data", "tombstones"):
            folder = self._path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if s.getPath().getName() not in named:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The vectors of a version (the newest if none is named), a snapshot of its files."""
        return self._rows(self.manifest(version))

    def _rows(self, m: dict) -> DataFrame:
        if not m["data"]:
            schema = StructType.fromJson(m["schema"]) if m["schema"] else f"{self.key} string, {self.column} array<float>"
            return self.spark.createDataFrame([], schema)
        schema = StructType.fromJson(m["schema"])
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{d['folder']}" for d in m["data"]))
        if not m["tombstones"]:
            return rows
        seqs = lambda entries: F.broadcast(self.spark.createDataFrame([(e["folder"], e["seq"]) for e in entries], "_folder string, _seq long"))
        folder = lambda kind: F.regexp_extract("_metadata.file_path", rf"/{kind}/([0-9a-f]+)/", 1)
        dead = self.spark.read.schema(StructType([schema[self.key]])).parquet(*(f"{self.root}/tombstones/{t['folder']}" for t in m["tombstones"]))
        dead = dead.withColumn("_folder", folder("tombstones")).join(seqs(m["tombstones"]), "_folder").groupBy(self.key).agg(F.max("_seq").alias("_dead"))
        live = rows.select(*schema.names, folder("data").alias("_folder")).join(seqs(m["data"]), "_folder").join(dead, self.key, "left")
        return live.where("_dead is null or _dead <= _seq").select(schema.names)
