"""Many model calls at once: a bounded pool per task, micro-batches, a rate limit, and a log of replies that outlives a task.

A task asks each distinct question of an Arrow batch once, MICRO questions at a time from ``spec.concurrency`` threads. With a
log folder every micro-batch is written down before the next begins, under the task's partition, keyed by a digest of
the model's settings and the question: a task that runs again after a lost executor reads what its partition wrote and asks only the
rest. The folder is reached through pyarrow's file systems (a shared mount, HDFS, S3 or GCS), as tasks write to it; a name
of a run keeps runs apart. ``replies`` reads a log as a table, so that a later run joins what is known instead of asking.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Questions of a micro-batch, for each thread of the pool.
MICRO = 8
_LOG = "key string, reply string, error string"


def key_of(spec, kind: str, question: tuple) -> str:
    """Digest of what decides a reply: the model's settings, the kind of call and the question."""
    told = {k: v for k, v in asdict(spec).items() if k not in ("retries", "backoff_s", "concurrency", "per_second")}
    return hashlib.blake2b(json.dumps([told, kind, question], sort_keys=True, default=str).encode(), digest_size=16).hexdigest()


class Rate:
    """At most ``per_second`` calls begin in a second, whichever thread they come from; None: no limit."""

    def __init__(self, per_second: float | None, clock=time.monotonic, sleep=time.sleep):
        self.gap = 1 / per_second if per_second else 0.0
        self.clock, self.sleep, self.next, self.lock = clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


class Log:
    """What one partition of a run has been told so far; every write is a new file, complete or absent."""

    def __init__(self, folder: str, run: str, partition: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.folder = f"{root.rstrip('/')}/run={run}/partition={partition}"

    def known(self) -> dict[str, tuple]:
        from pyarrow import fs

        found: dict[str, tuple] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        r = json.loads(line)
                        found[r["key"]] = r["reply"], r["error"]
        return found

    def write(self, replies: dict[str, tuple]) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name + ".tmp") as f:
            f.write("".join(json.dumps({"key": k, "reply": r, "error": e}) + "\n" for k, (r, e) in replies.items()).encode())
        self.fs.move(name + ".tmp", name + ".json")


class Caller:
    """Asks questions for one task. ``call`` takes a question's parts and gives (reply, error); failures are not logged, so they are asked again."""

    def __init__(self, spec, kind: str, call, log: tuple[str, str] | None = None):
        self.spec, self.kind, self.call, self.rate = spec, kind, call, Rate(spec.per_second)
        context = TaskContext.get()
        self.log = Log(*log, context.partitionId() if context else 0) if log else None
        self.known = self.log.known() if self.log else {}

    def _one(self, question: tuple) -> tuple:
        self.rate.wait()
        return self.call(*question)

    def ask(self, questions: list[tuple]) -> list[tuple]:
        """(reply, error) of every question; equal ones are asked once."""
        keys = [key_of(self.spec, self.kind, q) for q in questions]
        told = {k: self.known[k] for k in keys if k in self.known}
        new = {k: q for k, q in zip(keys, questions) if k not in told}
        todo = [*new.items()]
        threads = max(1, self.spec.concurrency)
        with ThreadPoolExecutor(threads) as pool:
            for s in range(0, len(todo), MICRO * threads):
                part = todo[s : s + MICRO * threads]
                got = dict(zip((k for k, _ in part), pool.map(self._one, (q for _, q in part))))
                told |= got
                if self.log and (good := {k: v for k, v in got.items() if not v[1]}):
                    self.log.write(good)
        return [told[k] for k in keys]


def replies(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """(key, reply) of a log, each key once; of one run or of all."""
    rows = spark.read.schema(_LOG + ", run string, partition int").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.where(F.col("run") == run) if run else rows
    return rows.where("error is null").groupBy("key").agg(F.min("reply").alias("reply"))


def keyed(column, spec, kind: str = "generate"):
    """The key of a question column, to join with replies()."""

    @F.pandas_udf("string")
    def run(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: key_of(spec, kind, (q, None)))

    return run(column)
