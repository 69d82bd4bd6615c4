"""Language, embedding and reranking models behind one interface, with deterministic offline stand-ins.

A provider is made once per Python worker from a picklable specification. Calls go through
``mapInPandas``, so a partition is the unit of retry and results must not depend on the attempt; a log of
replies (calls.py) keeps a retried one from asking twice. Providers may be called from several threads at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.calls import Caller
from hopweave.storage import bounded_batches


@dataclass(frozen=True)
class ModelSpec:
    """Which provider, and what it is told. Keys come from the environment, never from here."""

    provider: str = "stub"
    model: str = "stub"
    url: str = ""
    key_variable: str = ""
    temperature: float = 0.7
    max_tokens: int = 1000
    top_p: float = 1.0
    retries: int = 3
    backoff_s: float = 2.0
    dim: int = 64
    #: Calls of one task that run at the same time, and that begin in a second (None: as many as may).
    concurrency: int = 8
    per_second: float | None = None
    #: For the stub: pairs of a text that a prompt may hold and the reply to such prompts.
    options: tuple = field(default_factory=tuple)


class StubModel:
    """Answers that depend on the prompt alone: the reply its options have for it, else its last line's words; hashed vectors; word overlap as rerank score."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    def generate(self, prompt: str, image: str | None = None) -> str:
        for mark, reply in self.spec.options:
            if mark in (prompt or ""):
                return reply
        lines = [x for x in (prompt or "").split("\n") if x.strip()]
        tail = lines[-1].split(":", 1)[-1].strip() if lines else ""
        return f"stub answer to {tail}" if tail else ""

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.spec.dim)
        for w in (text or "").lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % self.spec.dim] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def embed_image(self, uri: str) -> list[float]:
        """An image by its path or data URI; the stub reads its words like a text's."""
        return self.embed(" ".join(re.findall(r"[A-Za-z0-9]+", uri or "")))

    def score(self, question: str, texts: list[str], images: list[str | None]) -> list[float]:
        """Relevance of texts (with their images, if any) to a question."""
        asked = {*(question or "").lower().split()}
        sets = [{*(t or "").lower().split()} for t in texts]
        return [len(asked & s) / len(asked | s) if asked | s else 0.0 for s in sets]


class HttpModel(StubModel):
    """An OpenAI-style completion server."""

    def _post(self, path: str, body: dict) -> dict:
        import os

        base = self.spec.url.rstrip("/")
        base = base if base.endswith("/v1") else base + "/v1"
        headers = {"Content-Type": "application/json"}
        if self.spec.key_variable and os.environ.get(self.spec.key_variable):
            headers["Authorization"] = "Bearer " + os.environ[self.spec.key_variable]
        with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode(), headers), timeout=120) as r:
            return json.load(r)

    def request(self, prompt: str, image: str | None = None) -> tuple[str, dict]:
        """Path and body: chat for multimodal models, plain completion for others."""
        common = {"model": self.spec.model, "temperature": self.spec.temperature, "max_tokens": self.spec.max_tokens, "top_p": self.spec.top_p}
        if image or "vl" in self.spec.model.lower():
            parts = [{"type": "text", "text": prompt}] + ([{"type": "image_url", "image_url": {"url": image}}] if image else [])
            return "/chat/completions", common | {"messages": [{"role": "user", "content": parts}]}
        return "/completions", common | {"prompt": prompt}

    def generate(self, prompt: str, image: str | None = None) -> str:
        path, body = self.request(prompt, image)
        choice = self._post(path, body)["choices"][0]
        return choice["message"]["content"] if "message" in choice else choice["text"]

    def embed(self, text: str) -> list[float]:
        return self._post("/embeddings", {"model": self.spec.model, "input": text})["data"][0]["embedding"]

    def embed_image(self, uri: str) -> list[float]:
        return self._post("/embeddings", {"model": self.spec.model, "input": [{"image": uri}]})["data"][0]["embedding"]

    def score(self, question: str, texts: list[str], images: list[str | None]) -> list[float]:
        """Texts of a batch in one call; a multimodal model gets the image beside the text. What the reply lacks scores 0."""
        told = [{"text": t, "image": i} if i else t for t, i in zip(texts, images)]
        out = [0.0] * len(texts)
        for r in self._post("/rerank", {"model": self.spec.model, "query": question, "documents": told})["results"]:
            out[r["index"]] = float(r.get("relevance_score") or 0.0)
        return out


class LetterModel(StubModel):
    """The stub, with vectors that SQL can say too: how often each letter from a to z is in a text."""

    def embed(self, text: str) -> list[float]:
        return [float((text or "").count(chr(97 + i))) for i in range(26)]


PROVIDERS: dict[str, Callable[[ModelSpec], StubModel]] = {"stub": StubModel, "http": HttpModel, "letters": LetterModel}
_made: dict[ModelSpec, StubModel] = {}


def register(name: str, factory: Callable[[ModelSpec], StubModel]) -> None:
    PROVIDERS[name] = factory


def model(spec: ModelSpec) -> StubModel:
    """The worker's instance; an unknown provider is the stub."""
    if spec not in _made:
        _made[spec] = PROVIDERS.get(spec.provider, StubModel)(spec)
    return _made[spec]


def carried(*specs: ModelSpec | None) -> dict[str, Callable]:
    """What the driver has registered for the specifications' providers; workers take it over before they make a model."""
    return {s.provider: PROVIDERS[s.provider] for s in specs if s is not None and s.provider in PROVIDERS}


def adopted(factories: dict[str, Callable]) -> None:
    for name, factory in factories.items():
        register(name, factory)


def forget() -> None:
    _made.clear()


def attempted(call: Callable[[], str], retries: int, backoff_s: float, sleep=time.sleep) -> tuple[str, str | None]:
    """(result, None), or ("", message) after the last attempt; waits grow linearly."""
    message = None
    for k in range(max(retries, 1)):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001 - a failing model is a row with an error, not a failing job
            message = f"{type(e).__name__}: {e}"
            if k + 1 < retries:
                sleep(backoff_s * (k + 1))
    return "", message


def generate(df: DataFrame, spec: ModelSpec, prompt: str = "prompt", image: str | None = None, out: str = "reply", multimodal: ModelSpec | None = None, log: tuple[str, str] | None = None) -> DataFrame:
    """Add the reply and an error column; rows with an image go to the multimodal model if there is one.

    Equal prompts of a batch are asked once, ``spec.concurrency`` at a time. log: (folder, run), where replies are written
    down, so that a task that runs again, or a run of the same name, asks only what it hasn't been told.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string, `{out}_error` string"

    factories = carried(spec, multimodal)
    bounded_batches(df.sparkSession)

    def run(batches):
        adopted(factories)

        def call(p, i):
            return attempted(lambda: model(multimodal if i and multimodal else spec).generate(p, i), spec.retries, spec.backoff_s)

        caller = Caller(spec, "generate" if multimodal is None else f"generate:{multimodal.provider}:{multimodal.model}", call, log)
        for pdf in batches:
            pictures = pdf[image] if image else [None] * len(pdf)
            got = caller.ask([*zip(pdf[prompt], pictures)])
            yield pdf.assign(**{out: [g[0] for g in got], f"{out}_error": [g[1] for g in got]})

    return df.mapInPandas(run, schema)


def _vectors(column, spec: ModelSpec, kind: str, call):
    """A vector column; asked once for each distinct value of a batch, and, being marked as not deterministic, only once in a plan that also filters by it."""

    factories = carried(spec)
    bounded_batches(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        adopted(factories)
        caller = Caller(spec, kind, lambda v: attempted(lambda: call(model(spec), v), spec.retries, spec.backoff_s))
        asked = [v for v in values if isinstance(v, str) and v.strip()]
        told = dict(zip(asked, caller.ask([(v,) for v in asked])))
        return pd.Series([None if v not in told or told[v][1] else told[v][0] for v in values], dtype=object)

    return run.asNondeterministic()(column)


def embed(column, spec: ModelSpec):
    """A vector column of a text column; null for blank texts and failures."""
    return _vectors(column, spec, "embed", lambda m, t: m.embed(t))


def embed_image(column, spec: ModelSpec):
    """A vector column of a column of image paths or data URIs; null for blanks and failures."""
    return _vectors(column, spec, "embed_image", lambda m, i: m.embed_image(i))


def rerank_score(question, text, image, spec: ModelSpec, batch: int = 4):
    """The reranker's score of each hit, in calls of up to ``batch`` hits of one question (a text longer than the model takes is cut by its server); null where the call fails."""

    factories = carried(spec)
    bounded_batches(SparkSession.active())

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series, images: pd.Series) -> pd.Series:
        adopted(factories)
        out = pd.Series(np.nan, index=questions.index)
        for q, at in questions.groupby(questions.fillna("")).groups.items():
            for s in range(0, len(at), batch):
                part = at[s : s + batch]
                got, error = attempted(lambda p=part, q=q: model(spec).score(q, texts[p].tolist(), images[p].tolist()), spec.retries, spec.backoff_s)
                if not error:
                    out[part] = got
        return out

    return F.nanvl(run(question, text, image), F.lit(None).cast("double"))


def cached_embeddings(texts: DataFrame, spec: ModelSpec, folder: str) -> DataFrame:
    """(text, vector) of distinct texts (column ``text``): known ones from the table in the folder, new ones embedded and added there.

    The table is partitioned by model and dimension, so no model meets another's vectors.
    """
    spark = texts.sparkSession
    name = f"{spec.provider}:{spec.model}"
    schema = "text string, vector array<float>, model string, dim int"
    asked = texts.select("text").where("text is not null").distinct()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    mine = lambda: spark.read.schema(schema).parquet(folder).where((F.col("model") == name) & (F.col("dim") == spec.dim)).select("text", "vector")
    new = asked.join(mine(), "text", "left_anti") if there else asked
    made = new.withColumn("vector", embed(F.col("text"), spec)).where(F.size("vector") == spec.dim)
    made.withColumns({"model": F.lit(name), "dim": F.lit(spec.dim)}).write.mode("append").partitionBy("model", "dim").parquet(folder)
    return asked.join(mine(), "text")


def gpu_settings(per_task: float = 1.0, per_executor: int = 1) -> dict[str, str]:
    """Session settings that hand each task its share of a GPU: Spark schedules devices, nobody picks them."""
    return {"spark.executor.resource.gpu.amount": str(per_executor), "spark.task.resource.gpu.amount": str(per_task)}
