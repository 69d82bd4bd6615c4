"""The data source ``node``: node files read and written by batch and stream, with commits in two phases.

    spark.dataSource.register(NodeDataSource)
    spark.read.format("node").load(path)
    nodes.write.format("node").mode("append").save(path)
    spark.readStream.format("node").load(path)
    nodes.writeStream.format("node").option("checkpointLocation", c).start(path)

A writing task puts its nodes into new files of at most ``maxFileBytes``, JSON lists with a node in each line. They
count only when the driver has published their names: one small file in ``_commits``, written aside and moved into place.
A failed task's files are named nowhere, so nobody reads them, and an aborted job deletes what its tasks told of. Overwriting is a
commit that leaves out all before it. A folder without commits, as other tools leave it, has all its ``*.node`` files.

Files are dealt to partitions of ``maxPartitionBytes``; files of a node a line are read line by line, others whole.
A stream's offset is the key of the last commit read (of foreign files, their time and name), a streamed batch is
committed under its number, so a batch that is written again after a restart stays one.

Paths are those of pyarrow's file systems (local or mounted, HDFS, S3, GCS): tasks and planning reach them without a JVM.
Unreadable files give no rows, items that are no objects are skipped; ``mode=FAILFAST`` raises instead.
"""

from __future__ import annotations

import io
import json
import re
import time
import uuid
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "id string, text string, modality string, image_path string, file_path string, metadata string, embedding array<float>"
_COMMITS = "_commits"
_ROWS = 1_000
_OWN = re.compile("part-[0-9a-f]{32}\\.node")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class _Folder:
    """A folder of node files and its commits."""

    def __init__(self, path: str):
        self.fs, root = _filesystem(path)
        self.root = root.rstrip("/")

    def _listed(self, folder: str, suffix: str) -> list:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((f for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith(".")), key=lambda f: f.base_name)

    def commits(self) -> list[dict]:
        """Published commits in order: key, tag, files, overwrite."""
        out = []
        for f in self._listed(f"{self.root}/{_COMMITS}", ".json"):
            with self.fs.open_input_stream(f.path) as s:
                out.append(json.loads(s.read()) | {"key": f.base_name.removesuffix(".json")})
        return out

    def _foreign(self) -> list:
        """Node files that no writer of this kind made."""
        return [f for f in self._listed(self.root, ".node") if not _OWN.fullmatch(f.base_name)]

    def files(self, after: str = "", until: str | None = None, all_commits: bool = False) -> list[tuple[str, str, int]]:
        """(key, path, bytes) of the files that count, those of commits after one key until another."""
        commits = self.commits()
        if not commits:
            found = [(f"{f.mtime_ns:020d}-{f.base_name}", f.path, f.size) for f in self._foreign()]
        else:
            if not all_commits:
                commits = commits[max((i for i, c in enumerate(commits) if c["overwrite"]), default=0) :]
            found = [(c["key"], f"{self.root}/{name}", size) for c in commits for name, size in c["files"]]
        return sorted(f for f in found if f[0] > after and (until is None or f[0] <= until))

    def publish(self, files: list[tuple[str, int]], overwrite: bool, tag: str = "") -> bool:
        """Make files count, at once; nothing if a commit of that tag is there."""
        earlier = self.commits()
        if tag and any(c["tag"] == tag for c in earlier):
            return False
        if not earlier and not overwrite:  # what other tools left here goes on to count
            files = [(f.base_name, f.size) for f in self._foreign()] + files
        last = int(earlier[-1]["key"].split("-")[0]) if earlier else 0
        name = f"{max(time.time_ns(), last + 1):020d}-{uuid.uuid4().hex[:12]}"
        self.fs.create_dir(f"{self.root}/{_COMMITS}", recursive=True)
        aside = f"{self.root}/{_COMMITS}/.{name}.tmp"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps({"files": files, "overwrite": overwrite, "tag": tag}).encode())
        self.fs.move(aside, f"{self.root}/{_COMMITS}/{name}.json")
        return True

    def delete(self, names: list[str]) -> None:
        for name in names:
            try:
                self.fs.delete_file(f"{self.root}/{name}")
            except FileNotFoundError:
                pass


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(None)
        self.paths = tuple(paths)


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _dealt(files: list[tuple[str, str, int]], limit: int) -> list[_Files]:
    """Files in partitions of at most ``limit`` bytes (a larger file alone)."""
    out, held, size = [], [], 0
    for _, path, n in files:
        if held and size + n > limit:
            out.append(_Files(held))
            held, size = [], 0
        held.append(path)
        size += n
    return out + ([_Files(held)] if held else [])


def _first(*values):
    return next((v for v in values if v not in (None, "")), None)


def _node(item: dict, path: str) -> dict:
    """A node of a file in the table's shape; vectors may lie one list deeper."""
    meta = item.get("metadata")
    known = meta if isinstance(meta, dict) else {}
    resource = item.get("image_resource")
    vector = _first(item.get("vector"), item.get("embedding"))
    if isinstance(vector, list) and vector and isinstance(vector[0], list):
        vector = [x for part in vector for x in part]
    image = _first(item.get("image_path"), known.get("image_path"), resource.get("path") if isinstance(resource, dict) else None)
    return {
        "id": _first(item.get("id"), known.get("id"), path.rsplit("/", 1)[-1].removesuffix(".node")), "text": _first(item.get("text"), item.get("content")) or "",
        "modality": item.get("modality") or ("image" if image or known.get("data_type") == "image" else "text"), "image_path": image, "file_path": _first(item.get("file_path"), known.get("file_path")),
        "metadata": meta if isinstance(meta, str) or meta is None else json.dumps(meta), "embedding": vector if isinstance(vector, list) else None,
    }


def _items(stream) -> Iterator:
    """The values of a file: of its lines if it has a value in each, else of the whole."""
    head = stream.readline()
    if head.strip() == b"[":
        for line in iter(stream.readline, b""):
            line = line.strip().removesuffix(b",")
            if line not in (b"", b"]"):
                yield json.loads(line)
        return
    found = json.loads(head + stream.read())
    yield from found if isinstance(found, list) else [found]


def _read(path: str, partition: _Files, schema: pa.Schema, strict: bool) -> Iterator[pa.RecordBatch]:
    fs, _ = _filesystem(path)
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        shown = lambda r, f: _numbers(r[f]) if f == "embedding" else None if r.get(f) is None else str(r[f])
        out = [pa.array([shown(r, f.name) for r in rows], f.type) for f in schema]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, schema=schema)

    for file in partition.paths:
        try:
            with io.BufferedReader(fs.open_input_stream(file)) as stream:
                for item in _items(stream):
                    if isinstance(item, dict):
                        rows.append(_node(item, file))
                        if len(rows) >= _ROWS:
                            yield batch()
        except (ValueError, UnicodeDecodeError):
            if strict:
                raise
    if rows:
        yield batch()


def _numbers(vector):
    """A vector as floats; null where any component is none."""
    if vector is None or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector):
        return None
    return [float(x) for x in vector]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self):
        files = _Folder(self.options["path"]).files()
        return _dealt(files, int(self.options.get("maxpartitionbytes", 64_000_000))) or [_Files(())]

    def read(self, partition):
        return _batches(self.options, self.schema, partition)


def _batches(options: dict, schema: StructType, partition: _Files):
    from pyspark.sql.pandas.types import to_arrow_schema

    return _read(options["path"], partition, to_arrow_schema(schema), options.get("mode", "").upper() == "FAILFAST")


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def initialOffset(self):
        return {"key": ""}

    def latestOffset(self):
        return {"key": max((f[0] for f in _Folder(self.options["path"]).files(all_commits=True)), default="")}

    def partitions(self, start, end):
        files = _Folder(self.options["path"]).files(start["key"], end["key"], all_commits=True)
        return _dealt(files, int(self.options.get("maxpartitionbytes", 64_000_000))) or [_Files(())]

    def read(self, partition):
        return _batches(self.options, self.schema, partition)

    def commit(self, end):
        pass


class _Writing:
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator):
        """Nodes into new files, which nobody reads before they are published."""
        folder, limit = _Folder(self.options["path"]), int(self.options.get("maxfilebytes", 64_000_000))
        folder.fs.create_dir(folder.root, recursive=True)
        files, out, name, size = [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                line = json.dumps({k: v for k, v in row.items() if v is not None}).encode()
                if out is not None and size + len(line) > limit:
                    out.write(b"\n]\n")
                    out.close()
                    files.append((name, size))
                    out = None
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.node", 0
                    out = folder.fs.open_output_stream(f"{folder.root}/{name}")
                    out.write(b"[\n" + line)
                else:
                    out.write(b",\n" + line)
                size += len(line) + 2
        if out is not None:
            out.write(b"\n]\n")
            out.close()
            files.append((name, size))
        return _Written(files)

    def _published(self, messages, tag: str = "") -> None:
        folder = _Folder(self.options["path"])
        files = [f for m in messages if m is not None for f in m.files]
        if not folder.publish(files, self.overwrite, tag):
            folder.delete([n for n, _ in files])

    def _dropped(self, messages) -> None:
        _Folder(self.options["path"]).delete([n for m in messages if m is not None for n, _ in m.files])


class _Writer(_Writing, DataSourceArrowWriter):
    def commit(self, messages):
        self._published(messages)

    def abort(self, messages):
        self._dropped(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        self._published(messages, f"{self.options.get('stream', 'stream')}-{batchId}")

    def abort(self, messages, batchId):
        self._dropped(messages)


class NodeDataSource(DataSource):
    """See the module. Options: path, maxPartitionBytes, maxFileBytes, mode, and for streamed writes ``stream``, the name that batches are numbered under."""

    @classmethod
    def name(cls) -> str:
        return "node"

    def schema(self) -> str:
        return SCHEMA

    def _told(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema):
        return _Reader(self._told(), schema)

    def streamReader(self, schema):
        return _StreamReader(self._told(), schema)

    def writer(self, schema, overwrite):
        return _Writer(self._told(), overwrite)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self._told(), overwrite)
