"""The session with this engine's defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hopweave.functions import register

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "hopweave", **conf: str) -> SparkSession:
    """Get or make a session; keyword names have dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    register.register_all(spark)
    return spark
