"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "saltmarsh", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI checks and adaptive execution; ``conf`` has further settings, _ for each dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
