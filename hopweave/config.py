"""Settings as one frozen value; a changed copy is made with ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "spark.hopweave."


@dataclass(frozen=True)
class Settings:
    text_dim: int = 1024
    cross_modal_dim: int = 512
    retrieval_top_k: int = 10
    rerank_top_k: int = 5
    rerank_enabled: bool = True
    confidence_threshold: float = 0.9
    gated: bool = False
    decomposition_attempts: int = 2
    max_preloaded_images: int = 5
    llm_retries: int = 3
    llm_backoff_s: float = 2.0
    temperature: float = 0.7
    max_tokens: int = 1000
    data_root: str = "data"

    def updated(self, **changes) -> Settings:
        """A copy with the known settings changed; unknown names are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})

    @classmethod
    def from_session(cls, spark: SparkSession) -> Settings:
        """Defaults overridden by ``spark.hopweave.*`` settings of the session."""
        got = {}
        for f in fields(cls):
            raw = spark.conf.get(PREFIX + f.name, None)
            if raw is not None:
                kind = type(f.default)
                got[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**got)
