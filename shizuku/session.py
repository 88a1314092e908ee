"""Sessions with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "shizuku", master: str | None = None, **settings: str) -> SparkSession:
    """Times in UTC, ANSI on, adaptive execution on, all of Java's encodings readable. Partition counts stay the cluster's, unless set."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.legacy.javaCharsets": "true"}
    return builder.config(map=fixed | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
