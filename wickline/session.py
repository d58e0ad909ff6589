"""Spark session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "wickline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI and adaptive execution; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
